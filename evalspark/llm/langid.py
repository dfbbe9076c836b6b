"""Language identification with segmentation-marginalised unigrams.

A fixed public piece vocabulary; per language a probability of every piece. The
probability of a word is the sum over all its segmentations into pieces of the
product of their probabilities (a forward algorithm); a text's is the product over
its words (maximal runs of letters, lower-cased, each with the word-start mark).

The piece probabilities come from expectation maximisation (expected piece counts
over all segmentations, forward-backward, both kept in scale) on the word counts of a
sample of labelled rows: ``FIT_DOCS`` whole distinct texts a language, those with the
smallest hash. Spark counts their words, and a task a language fits them; the driver
gets one number for every piece and language. The ``LANGUAGES`` most frequent values of
lang are learned, so that a dirty column cannot make the model larger than that. All
else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, lean, prepared

FIT_DOCS = 400       # distinct labelled texts a language that the probabilities are fitted on, at most
LANGUAGES = 256      # learned, the most frequent ones
ROUNDS = 3           # of expectation maximisation
UNKNOWN = 1e-9       # probability of a character that is no piece
START = "▁"     # word-start mark of the vocabulary
UNDETERMINED = "und"
CELLS = 2_000_000    # word positions handled at once
SLICE = 4_000_000    # characters of text handled at once, about
KNOWN = 250_000      # words that a task remembers; then it begins anew
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs of a text."""
    return _WORDS(text.lower()) if text else []


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model file, lower-cased, that are letters
    behind an optional word-start mark; single letters included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {START}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower()
            body = piece.removeprefix(START)
            if body and body.isalpha():
                found.add(piece)
    return sorted(found)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of the words with their start mark, zero-padded."""
    text = "".join((START + w).ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), width)


class Lattice:
    """For every word position and piece length, the piece that starts there."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            by_length.setdefault(len(p), []).append((h, i))
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64))
        self.unknown = len(pieces)      # index of the fallback for one character
        self.nothing = len(pieces) + 1  # index of probability zero

    def match(self, codes: np.ndarray) -> np.ndarray:
        """(position, length - 1) -> piece index, for a block of words of one width."""
        n, width = codes.shape
        out = np.full((width, self.longest, n), self.nothing, np.int32)
        out[:, 0][(codes != 0).T] = self.unknown
        h = np.zeros((n, width), np.uint64)
        for size in range(1, min(self.longest, width) + 1):
            h = h[:, :width - size + 1] * _BASE + codes[:, size - 1:].astype(np.uint64) + np.uint64(1)
            if size in self.tables:
                keys, index = self.tables[size]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = (keys[at] == h) & (codes[:, size - 1:] != 0)
                out[:width - size + 1, size - 1][hit.T] = index[at].T[hit.T]
        return out


def forward(matches: np.ndarray, probabilities: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations, one row a word and one
    column a language. ``probabilities`` has a row a piece, then the fallback, then
    zero. Sums are kept in scale, so words of any length are exact."""
    width, longest, n = matches.shape
    k = probabilities.shape[1]
    tail = [np.zeros((n, k)) for _ in range(longest - 1)] + [np.ones((n, k))]  # sums at the last positions
    scale = np.zeros((n, k))
    out = np.zeros((n, k))
    for end in range(1, width + 1):
        total = np.zeros((n, k))
        for size in range(1, min(longest, end) + 1):
            piece = matches[end - size, size - 1]
            live = np.nonzero(piece != probabilities.shape[0] - 1)[0]
            if len(live):
                total[live] += tail[-size][live] * probabilities[piece[live]]
        tail = [*tail[1:], total]
        ending = lengths == end
        if ending.any():
            out[ending] = np.log(total[ending]) + scale[ending]
        if end % 16 == 0:
            top = np.max(tail, axis=0)
            top[top <= 0] = 1.0
            tail = [t / top for t in tail]
            scale += np.log(top)
    return out


def _blocks(words: list[str], longest: int) -> Iterator[np.ndarray]:
    """Indices of words of like length, as many as ``CELLS`` positions hold."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        width = int(sizes[order[i]]) + 1
        # words up to a quarter longer share a block; the block's width is that of its longest
        j = min(int(np.searchsorted(sizes[order], width * 5 // 4, side="right")), i + max(1, CELLS // (width * longest)))
        yield order[i:j]
        i = j


def word_scores(words: list[str], lattice: Lattice, probabilities: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for block in _blocks(words, lattice.longest):
        own = [words[i] for i in block.tolist()]
        lengths = np.fromiter(map(len, own), np.int64, len(own)) + 1
        out[block] = forward(lattice.match(_codes(own, int(lengths.max()))), probabilities, lengths)
    return out


def _scaled_sums(width: int, longest: int, n: int, starts: np.ndarray, step) -> tuple[np.ndarray, np.ndarray]:
    """(sums, log scales) of paths to positions 0..width for ``n`` words: position
    ``starts`` of a word has one path, ``step(at, size, sums)`` is what arrives ``at``
    from ``size`` positions before."""
    sums, scales = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    tail, scale = [np.zeros(n) for _ in range(longest)], np.zeros(n)
    for at in range(width + 1):
        total = (starts == at).astype(np.float64)  # nothing came before, so its scale is 1
        for size in range(1, min(longest, at) + 1):
            total += step(at, size, tail[-size])
        sums[at], scales[at] = total, scale
        tail = [*tail[1:], total]
        if at % 8 == 7:
            top = np.max(tail, axis=0)
            top[top <= 0] = 1.0
            tail = [t / top for t in tail]
            scale = scale + np.log(top)
    return sums, scales


def expected_counts(words: list[str], weights: np.ndarray, lattice: Lattice, probabilities: np.ndarray) -> np.ndarray:
    """Expected use of every piece over all segmentations of the words (one language)."""
    counts = np.zeros(len(probabilities))
    for block in _blocks(words, lattice.longest):
        own = [words[i] for i in block.tolist()]
        lengths = np.fromiter(map(len, own), np.int64, len(own)) + 1
        width, n = int(lengths.max()), len(own)
        matches = lattice.match(_codes(own, width))
        before, up = _scaled_sums(width, lattice.longest, n, np.zeros(n), lambda at, size, sums: sums * probabilities[matches[at - size, size - 1]])
        # positions counted from the block's end: a word begins where its letters end
        after, down = _scaled_sums(width, lattice.longest, n, width - lengths, lambda at, size, sums: sums * probabilities[matches[width - at, size - 1]])
        with np.errstate(divide="ignore"):  # no path: minus infinity
            before, after, chances = np.log(before) + up, np.log(after) + down, np.log(probabilities)
        whole = before[lengths, np.arange(n)]
        for at in range(width):
            for size in range(1, min(lattice.longest, width - at) + 1):
                piece, end = matches[at, size - 1], width - at - size
                use = np.exp(before[at] + chances[piece] + after[end] - whole)
                counts += np.bincount(piece, use * weights[block], len(probabilities))
    return counts


def fitted(words: list[str], weights: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Piece probabilities of one language, then the fallback's, then zero."""
    n = len(lattice.pieces)
    p = np.full(n + 2, 1.0 / n)
    p[-1], p[-2] = 0.0, UNKNOWN
    for _ in range(ROUNDS):
        expected = expected_counts(words, weights, lattice, p)[:n] + 0.01
        p[:n] = expected / expected.sum()
    return p


@dataclass
class Model:
    """Languages, their pieces and the natural probabilities of the pieces."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray

    def predict(self, texts: list[str | None], scorer: Scorer | None = None) -> tuple[list[str], np.ndarray]:
        """(language, posterior probability) of each text; ``und`` and 0 without a letter
        or without any language to choose from."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums, empty = (scorer or Scorer(self)).sums(texts)
        best = sums.argmax(axis=1)
        score = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [UNDETERMINED if e else self.languages[b] for b, e in zip(best.tolist(), empty.tolist())], np.where(empty, 0.0, score)


class Scorer:
    """Scores of texts by a model; a word is scored once as long as it is remembered."""

    def __init__(self, model: Model):
        self.lattice, self.probabilities = Lattice(model.pieces), model.probabilities
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KNOWN:
            self.known, self.scores = {}, self.scores[:0]
        index, had = self.known, len(self.known)
        refs = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int32) for t in texts]
        new = list(islice(index, had, None))
        if new:
            self.scores = np.concatenate([self.scores, word_scores(new, self.lattice, self.probabilities)])
        sums = np.array([self.scores[r].sum(axis=0) for r in refs]).reshape(len(texts), self.scores.shape[1])
        return sums, np.fromiter((len(r) == 0 for r in refs), bool, len(refs))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log P(text | language) of each text, whether it has no letter), a few million
        characters at a time."""
        ends = np.cumsum([len(t or "") for t in texts]) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        found = [self._sums(texts[a:b]) for a, b in pairwise(cuts)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = pa.array(words_of(text), pa.string()).value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.field(0), words.field(1)], ["lang", "word", "n"])

    return texts.mapInArrow(lean(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``FIT_DOCS`` distinct texts of each language of ``labelled`` (rows with a
    null language or text are left out)."""
    spark = prepared(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    common = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    picked = hash_sample(rows.dropDuplicates(["lang", "h"]), "lang", "h", {r["lang"]: r["n"] for r in common.collect()}, FIT_DOCS)
    shipped = spark.sparkContext.broadcast(pieces)

    def one(key: tuple, words: pa.Table) -> pa.Table:
        p = fitted(words.column("word").to_pylist(), words.column("n").to_numpy().astype(np.float64), Lattice(shipped.value))
        return pa.table({"lang": [key[0].as_py()], "p": pa.array([p.tolist()], pa.list_(pa.float64()))})

    # the words of FIT_DOCS texts, counted, are one language's group
    found = sorted((r["lang"], r["p"]) for r in _word_counts(picked.select("lang", "text")).groupBy("lang").applyInArrow(one, "lang string, p array<double>").collect())
    table = np.array([p for _, p in found]).T if found else np.zeros((len(pieces) + 2, 0))
    return Model([lang for lang, _ in found], pieces, table)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the last columns lang_pred and score, in place of any of these names.

    Null and empty texts and texts without a letter are ``und`` with score 0, as are
    all texts of a model without languages. Repeated rows get equal results; equal
    scores go to the first language by name.
    """
    docs = docs.drop("lang_pred", "score")
    prepared(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer = shipped.value, None
        for batch in batches:
            scorer = scorer or Scorer(own)
            lang, score = own.predict(batch.column(at).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
