"""Alignment of two tokenizers over a corpus: which tokens of A overlap which tokens of B,
and in how many documents each pair of ids does.

A reads space+text, B the text (it puts the space before by itself). A document's links
are the A-B occurrences whose bytes overlap; offsets where both end cut it into groups.

1. First pass: documents are aligned in parts (``PART_CHARS`` characters of one Arrow
   batch). A part gives its distinct id pairs with the number of its documents that hold
   them, packed by buckets of the pair's hash, the links of each of its distinct chunks
   as numbers of those pairs, and of each document what needs no counts, with the numbers
   of its chunks.
2. The distinct pairs of a bucket are united in a tree (``FAN`` sets at a time) and get a
   minimal perfect hash: levels of bits, a key takes the bit of the first level on which
   no other key claims it, its number is the rank of that bit. The keys lie in a table
   in the order of their numbers, so that a lookup verifies the key.
3. A group of ``FAN`` parts becomes a dense vector of counts a bucket, indexed by that
   hash; the vectors are summed in a tree, ``FAN`` at a time.
4. Each part's pairs are looked up; its counts travel to the part, are summed over each
   chunk's links once, and each document sums its chunks. No text is encoded twice.

All that meets in a task is bounded by ``FAN``, a part, and the vocabularies: there are at
most (ids of A) x (ids of B) pairs, so a bucket has a ``BUCKETS``-th of 1.6 billion at the
public vocabularies, whatever the corpus. A part is a run of rows as they are read, so no
id, source or group of copies gathers anywhere. Only the highest count of each A id (one
number an id) goes through the driver.

Texts are cut before spaces that follow other than white space, where no token of either
side can cross: A's pattern has white space only in front of a word, and B has no piece
with a space behind other characters (checked when B is loaded; else a text is one chunk).
Chunks are aligned once and remembered.

Defined results: null and empty texts, and texts that either side does not give back byte
by byte (U+2581 comes back as a space from B), have no tokens: zeros and an empty digest.
Every row counts as a document, rows that repeat an id or a text too; a null id stays null;
an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import splitter
from .common import prepared, ragged, shared_path

PART_CHARS = 24_000_000  # of text in a part, if its Arrow batch has so many (a longer text: alone)
KNOWN = 300_000          # chunks that a worker remembers; then it begins anew
BUCKETS, FAN = 1024, 32
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_AFTER_WHITE = re.compile(f"[{WHITE_SPACE}] ").search
_CUTS = re.compile(f"(?<=[^{WHITE_SPACE}])(?= )").split


# --- minimal perfect hashing ----------------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class MinimalHash:
    """Distinct keys to 0..n-1, each number once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        counts = [0, *np.cumsum([int(bits.sum()) for bits in levels]).tolist()]
        self.ranks = [np.cumsum(bits) - 1 + before for bits, before in zip(levels, counts)]

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        levels = []
        while len(keys):
            size = 2 * len(keys) + 1
            at = (mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not built in, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (mixed(keys[open_], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        at, levels = 4 * (n + 1), []
        for size in np.frombuffer(data, "<u4", n, 4).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)


class CountIndex:
    """A hash with its keys, and a dense vector of counts in the hash's order."""

    def __init__(self, levels: bytes, keys: bytes, counts: bytes | None = None):
        self.hash, self.keys = MinimalHash.from_bytes(levels), np.frombuffer(keys, "<u8")
        self.counts = np.zeros(len(self.keys), np.int64) if counts is None else np.frombuffer(counts, "<i8")

    @staticmethod
    def build(keys: np.ndarray) -> tuple[bytes, bytes]:
        """(levels, keys in the order of their numbers)."""
        found = MinimalHash.build(keys)
        ordered = np.empty(len(keys), "<u8")
        ordered[found(keys)] = keys
        return found.to_bytes(), ordered.tobytes()

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, verified."""
        at = self.hash(keys)
        if len(keys) and (at.min() < 0 or (self.keys[at] != keys).any()):
            raise KeyError("a pair that the first pass has not seen")
        return at


# --- the two tokenizers -------------------------------------------------------------

def byte_symbols() -> dict[int, str]:
    """Byte -> the character that byte-level vocabularies write for it: a printable
    Latin-1 byte is itself, the others follow from U+0100 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + rest.index(b)) for b in range(256)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, start of each, length of each)."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Aligner:
    """Chunks of text with both sides' ids, groups and links."""

    def __init__(self, a_json: str, b_model: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        symbols = byte_symbols()
        byte_of = {s: b for b, s in symbols.items()}
        vocabulary = json.loads(a_json)["model"]["vocab"]
        a_tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""
        self.a = Tokenizer.from_str(a_json).model
        self.symbols, self.split = symbols, splitter(pattern).findall
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_table, self.b_table, self.n_b = _table(a_tokens), _table(b_tokens), len(pieces)
        self.numerals = [str(i) for i in range(max(len(a_tokens), len(pieces)))]
        self.forget()

    def forget(self) -> None:
        self.known, self.pieces = _Numbers(), {}
        self.n_a = self.n_b_tokens = self.n_groups = self.n_links = np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)
        self.links = np.zeros(0, np.uint64)  # of all known chunks, a's id times B's vocabulary plus b's id
        self.starts = np.zeros(0, np.int64)  # of each chunk in links
        self.groups: list[str] = []

    def chunks(self, text: str | None) -> list[str]:
        """space+text in chunks, each without the space that it begins with."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        if _SPACE_AFTER_WHITE(" " + text):
            return [c[1:] for c in _CUTS(" " + text)]
        return text.split(" ")

    def _a_ids(self, keys: list[str]) -> list[list[int]]:
        known, out = self.pieces, []
        for key in keys:
            ids: list[int] = []
            for piece in self.split(" " + key):
                found = known.get(piece)
                if found is None:
                    known[piece] = found = [t.id for t in self.a.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]
                ids += found
            out.append(ids)
        return out

    def _b_ids(self, keys: list[str]) -> list[list[int]]:
        # the library gives an empty text no space
        return [ids if key else [self.b.piece_to_id("▁")] for key, ids in zip(keys, self.b.encode(keys, num_threads=1))]

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes

    @staticmethod
    def _gives(table, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ids of a chunk (``counts`` each) are its bytes."""
        raw, starts, lengths = table
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])
        stops = np.cumsum(counts)
        same = ends[stops] - ends[stops - counts] == sizes
        fit = np.repeat(same, counts)  # tokens of chunks of the right length
        got = raw[ragged(starts[ids[fit]], lengths[ids[fit]])]
        wrong = got != data[np.repeat(same, sizes)]
        chunk = np.repeat(np.flatnonzero(same), sizes[same])
        same[chunk[wrong]] = False
        return same

    def _learn(self, keys: list[str]) -> None:
        """Align chunks that are not known yet."""
        raw = [(" " + k).encode() for k in keys]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        a, n_a = self._flat(self._a_ids(keys))
        b, n_b = self._flat(self._b_ids(keys))
        good = self._gives(self.a_table, a, n_a, data, sizes) & self._gives(self.b_table, b, n_b, data, sizes)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        a_len, b_len = self.a_table[2][a], self.b_table[2][b]
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        # the B tokens over each A token's bytes
        first, last = np.searchsorted(b_end, a_end - a_len, "right"), np.searchsorted(b_end, a_end, "left")
        per_a = last - first + 1
        links = np.repeat(a, per_a) * self.n_b + b[ragged(first, per_a)]
        a_stops = np.cumsum(n_a)
        per_chunk = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[a_stops] - c[a_stops - n_a]
        n_links = per_chunk(per_a)
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, links.astype(np.uint64)])
        for name, x in (("n_a", n_a), ("n_b_tokens", n_b), ("n_groups", per_chunk(a_cut)), ("n_links", n_links), ("bad", ~good)):
            setattr(self, name, np.concatenate([getattr(self, name), x]))
        self.groups += self._written(a, a_cut, b, b_cut, n_a)

    def _written(self, a, a_cut, b, b_cut, n_a) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each chunk."""
        if not len(a):
            return [""] * len(n_a)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        place = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(place, kind="stable")
        ids, place = np.concatenate([a, b])[order], place[order]
        # what follows a token: its side goes on, the other side, another group, another chunk
        mark = np.ones(len(place), np.int64) * 3
        mark[:-1] = np.where(place[1:] == place[:-1], 0, np.where(place[1:] == place[:-1] + 1, np.where(place[:-1] % 2 == 0, 1, 2), 2))
        some = n_a > 0
        chunk_ends = np.concatenate([[0], np.cumsum(a_cut)])[np.cumsum(n_a)[some]]  # groups up to each chunk's end
        last = np.searchsorted(place, 2 * chunk_ends - 1, "right") - 1
        mark[last] = 3
        numerals, after = self.numerals, (",", "|", ";", "\n")
        texts = "".join(chain.from_iterable((numerals[i], after[m]) for i, m in zip(ids.tolist(), mark.tolist()))).split("\n")
        out = [""] * len(n_a)
        for k, t in zip(np.flatnonzero(some).tolist(), texts):
            out[k] = t
        return out

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's chunks, in order; of a text that does not come
        back byte by byte, none."""
        had, number = len(self.known), self.known.__getitem__
        refs = [np.fromiter(map(number, self.chunks(t)), np.int32) for t in texts]
        new = list(islice(self.known, had, None))
        for k in range(0, len(new), 20_000):
            self._learn(new[k:k + 20_000])
        return [r[:0] if self.bad[r].any() else r for r in refs]


_ALIGNERS: list[tuple] = []  # of this worker: at most one, kept from task to task


def _aligner(made_of: tuple) -> Aligner:
    if not _ALIGNERS or _ALIGNERS[0][0] is not made_of:
        _ALIGNERS[:] = [(made_of, Aligner(*made_of))]
    return _ALIGNERS[0][1]


# --- first pass -----------------------------------------------------------------------

PARTS = "part long, id long, n_a long, n_b long, n_groups long, n_links long, digest binary, refs binary, sizes binary, links binary, packed array<struct<bucket:int,pairs:binary,n:binary>>"
_PACKED = pa.list_(pa.struct([("bucket", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary())]))
_ARROW_PARTS = pa.schema([*((c, pa.int64()) for c in ("part", "id", "n_a", "n_b", "n_groups", "n_links")), *((c, pa.binary()) for c in ("digest", "refs", "sizes", "links")), ("packed", _PACKED)])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32: the lowest bytes of all, then the next ones (small numbers compress well)."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of ``lengths`` values."""
    ends = np.cumsum(lengths)
    totals = np.concatenate([[0], np.cumsum(values)])
    return totals[ends] - totals[ends - lengths]


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) % np.uint64(BUCKETS)).astype(np.int64)


def _pack(pairs: np.ndarray, counts: np.ndarray) -> list[dict]:
    bucket = _buckets(pairs)
    order = np.argsort(bucket, kind="stable")
    pairs, counts, bucket = pairs[order].astype("<u8"), counts[order].astype("<u4"), bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=BUCKETS))
    return [{"bucket": int(bucket[x]), "pairs": pairs[x:y].tobytes(), "n": counts[x:y].tobytes()} for x, y in zip(cuts[:-1], cuts[1:])]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART_CHARS or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _first_pass(made_of) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            whole = texts.to_pylist()
            for x, y in _slices(whole):
                aligner = _aligner(made_of.value)
                refs = aligner.read(whole[x:y])
                used = np.zeros(len(aligner.known), bool)
                for r in refs:
                    used[r] = True
                own, place = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1
                sizes = aligner.n_links[own]
                # links as numbers of the part's pairs
                pairs, links = np.unique(aligner.links[ragged(aligner.starts[own], sizes)], return_inverse=True)
                starts, counts = np.cumsum(sizes) - sizes, np.zeros(len(pairs), np.int64)
                sums, digests, numbers = [[] for _ in SUMS], [], []
                for r in refs:
                    at = place[r]
                    chunks = np.unique(at)
                    counts[np.unique(links[ragged(starts[chunks], sizes[chunks])])] += 1
                    for out, v in zip(sums, (aligner.n_a, aligner.n_b_tokens, aligner.n_groups, aligner.n_links)):
                        out.append(int(v[r].sum()))
                    digests.append(hashlib.sha256(";".join(map(aligner.groups.__getitem__, r.tolist())).encode()).digest() if len(r) else None)
                    numbers.append(planes(at))
                none = lambda t: pa.nulls(y - x, t)  # noqa: B023, E731
                rows = [pa.array([part] * (y - x), pa.int64()), ids.slice(x, y - x), *(pa.array(v, pa.int64()) for v in sums), pa.array(digests, pa.binary()), pa.array(numbers, pa.binary()), none(pa.binary()), none(pa.binary()), none(_PACKED)]
                yield pa.RecordBatch.from_arrays(rows, schema=_ARROW_PARTS)
                last = (part, *[None] * 7, planes(sizes), planes(links), _pack(pairs, counts))
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, _ARROW_PARTS)], schema=_ARROW_PARTS)
                if len(aligner.known) > KNOWN:
                    aligner.forget()
                part += 1
    return run


# --- the count index --------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows in order of their first ``keys`` columns, as (key, rows of the key)."""
    from itertools import groupby

    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    yield from groupby(rows, key=lambda r: r[:keys])


def _streamed(df: DataFrame, keys: list[str], order: list[str], rows_of: Callable, schema: str) -> DataFrame:
    """``rows_of(key, rows)`` for the rows of each key, in order, as they come."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields, n = to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, rows in _runs(batches, n):
            for row in rows_of(key, rows):
                held.append(row)
                size += sum(len(c) for c in row if isinstance(c, bytes))
                if size > 4 << 20 or len(held) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _united(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    sets = [np.frombuffer(r[2], "<u8") for r in rows]
    yield *key, np.unique(np.concatenate(sets)).tobytes()


def _summed(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    total = None
    for r in rows:
        own = np.frombuffer(r[2], "<i8")
        total = own.copy() if total is None else total + own
    yield *key, total.tobytes()


def _tree(df: DataFrame, groups: int, combine: Callable) -> DataFrame:
    """(bucket, grp, data) with one row a bucket, ``FAN`` groups at a time."""
    while groups > 1:
        groups = -(-groups // FAN)
        df = _streamed(df.withColumn("grp", F.expr(f"grp div {FAN}").cast("int")), ["bucket", "grp"], [], combine, "bucket int, grp int, data binary")
    return df


def _functions(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    for r in rows:
        yield key[0], *CountIndex.build(np.frombuffer(r[1], "<u8"))


def _vectors(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A group of parts: the hash of the bucket comes first, then the parts' pairs."""
    index = None
    for _, _, part, pairs, n, levels, keys, _ in rows:
        if part is None:
            index = CountIndex(levels, keys)
        else:
            index.counts[index.numbers(np.frombuffer(pairs, "<u8"))] += np.frombuffer(n, "<u4")
    yield *key, index.counts.astype("<i8").tobytes()


def _looked_up(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    index = None
    for _, _, part, pairs, _, levels, keys, counts in rows:
        if part is None:
            index = CountIndex(levels, keys, counts)
        else:
            yield part, pairs, index.counts[index.numbers(np.frombuffer(pairs, "<u8"))].astype("<i8").tobytes()


def _highest(n_b: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.frombuffer(keys, "<u8").astype(np.int64) // n_b
                ids, at = np.unique(a, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, at, np.frombuffer(counts, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["a", "best"])
    return run


def _with_index(packed: DataFrame, index: DataFrame, groups: int) -> DataFrame:
    """The parts' pairs and, before them in every group of parts, the bucket's index."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    heads = heads.select("bucket", "grp", none("part", "long"), none("pairs", "binary"), none("n", "binary"), "levels", "keys", "counts")
    return heads.unionByName(packed.select("*", none("levels", "binary"), none("keys", "binary"), none("counts", "binary")))


# --- second pass ------------------------------------------------------------------------

SUMS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _second_pass(n_b: int, best) -> Callable:
    """Rows by (part, kind): a part's counts, the links of its chunks, its documents."""
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def per_chunk(found: list[tuple], sizes: np.ndarray, links: np.ndarray) -> list[np.ndarray]:
        """Of each chunk: links whose count is their A id's highest, and the sum of counts."""
        pairs, counts = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(pairs)  # the numbers in links are places in this order
        pairs, counts = pairs[order], counts[order]
        top = counts == best.value[pairs.astype(np.int64) // n_b]
        return [_sums(v[links], sizes) for v in (top, counts)]

    def documents(rows: pa.RecordBatch, chunks: list[np.ndarray]) -> pa.RecordBatch:
        refs = [unplaned(r) for r in rows.column(8).to_pylist()]
        n, at = np.fromiter(map(len, refs), np.int64, len(refs)), np.concatenate(refs)
        digests = [d.hex() if d else "" for d in rows.column(7).to_pylist()]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(2, 7)), *(pa.array(_sums(v[at], n), pa.int64()) for v in chunks), pa.array(digests, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, chunks = None, [], []
        _ALIGNERS.clear()  # the first pass left it to this worker
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            changes = np.flatnonzero((np.diff(parts, prepend=parts[0] - 1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for x, y in zip(changes.tolist(), [*changes[1:].tolist(), len(parts)]):
                if part is None or parts[x] != part:
                    part, found = parts[x], []
                rows = batch.slice(x, y - x)
                if kinds[x] == 0:
                    found += [(np.frombuffer(p, "<u8"), np.frombuffer(c, "<i8")) for p, c in zip(rows.column(8).to_pylist(), rows.column(9).to_pylist())]
                elif kinds[x] == 1:
                    chunks = per_chunk(found, *(unplaned(rows.column(c)[0].as_py()) for c in (8, 9)))
                    found = []
                else:
                    yield from (documents(rows.slice(k, 256), chunks) for k in range(0, y - x, 256))
    return run


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of ``docs`` (columns of ``ALIGNED``). ``a_path``: a byte-level
    BPE in JSON whose pre-tokenizer is ``pattern``; ``b_path``: a sentencepiece model."""
    spark = prepared(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        sides = f.read(), g.read(), pattern
    made_of = spark.sparkContext.broadcast(sides)
    path = shared_path(spark, "alignment")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = written(small.mapInArrow(_first_pass(made_of), PARTS), "parts")
    marked = parts.where("packed is not null").select("part", "packed")
    groups = -(-max(1, marked.count()) // FAN)
    packed = marked.select("part", F.explode("packed").alias("p")).select("p.bucket", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("grp"), "part", "p.pairs", "p.n")

    sets = _streamed(packed.select("bucket", "grp", "pairs"), ["bucket", "grp"], [], _united, "bucket int, grp int, data binary")
    functions = written(_streamed(_tree(sets, groups, _united).select("bucket", "data"), ["bucket"], [], _functions, "bucket int, levels binary, keys binary"), "functions")
    empty = functions.withColumn("counts", F.lit(None).cast("binary"))
    vectors = _streamed(_with_index(packed, empty, groups), ["bucket", "grp"], ["part"], _vectors, "bucket int, grp int, data binary")
    counted = functions.join(_tree(vectors, groups, _summed).select("bucket", F.col("data").alias("counts")), "bucket")
    index = written(counted, "index")

    # one number for each id of A
    n_b = Aligner(*sides).n_b
    tops = index.select("keys", "counts").mapInArrow(_highest(n_b), "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toArrow()
    best = np.zeros(int(max(tops.column("a").to_pylist(), default=0)) + 1, np.int64)
    best[tops.column("a").to_numpy()] = tops.column("best").to_numpy()

    found = _streamed(_with_index(packed, index, groups), ["bucket", "grp"], ["part"], _looked_up, "part long, pairs binary, counts binary")
    empty_sums = [F.lit(None).cast("long").alias(c) for c in ("id", *SUMS)]
    digest = F.lit(None).cast("binary").alias("digest")
    rows = found.select("part", F.lit(0).alias("kind"), *empty_sums, digest, F.col("pairs").alias("x"), F.col("counts").alias("y"))
    rows = rows.unionByName(parts.where("packed is not null").select("part", F.lit(1).alias("kind"), *empty_sums, digest, F.col("sizes").alias("x"), F.col("links").alias("y")))
    rows = rows.unionByName(parts.where("packed is null").select("part", F.lit(2).alias("kind"), "id", *SUMS, "digest", F.col("refs").alias("x"), F.lit(None).cast("binary").alias("y")))
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_second_pass(n_b, spark.sparkContext.broadcast(best)), ALIGNED)
