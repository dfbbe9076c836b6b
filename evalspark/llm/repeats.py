"""Exact substring dedup by the common-prefix interval tree of enhanced suffix arrays.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else
is found, over all texts, without sorting all suffixes:

1. Anchors. In every window of ``length`` bytes the gram of ``GRAM`` bytes with the
   smallest hash (leftmost on ties) is its anchor. Equal windows have equal anchors at
   equal places, so only suffixes at anchors need comparing: two positions in
   ``length - GRAM``, about.
2. Contexts. An anchor's context is the union of the windows that chose it. Anchors
   are counted by gram and context hash. A context that occurs twice is covered whole;
   an anchor whose gram occurs once is done. What stays are grams with several
   distinct contexts, one occurrence each.
3. Suffix arrays. The contexts of a gram are sorted by what follows the anchor
   (suffix array, LCP array), and a stack scan makes its tree of common-prefix
   intervals. In every interval the left extensions are compared (ranks and common
   suffixes of the reversed left contexts): occurrences that reach ``length`` bytes
   together, left and right, are a repeat group; a group whose members extend to the
   left by different bytes is maximal, and is given with all its occurrences.
4. A gram with more than ``GROUP`` distinct contexts (a line that very many texts
   hold) is never brought into one task: its windows are counted by hash in two
   steps, first keys of ``length - STEP + 1`` bytes every ``STEP`` bytes, then the
   windows around keys that occur twice. This is exact as well.

Texts are UTF-8 bytes; null texts are empty; matches never cross texts; a row that
repeats another one is a copy like any other.

Passages are a second measure, in words: runs of words that several rows hold, however
short their words are and whatever white space parts them. Anchors are chosen as above,
over word hashes, and counted by row; the windows around anchors that enough rows hold
are counted by hash. This is exact as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepared, release, stored, utf8_buffers

LENGTH = 400
GRAM = 128  # a power of two
GROUP = 4096   # distinct contexts of a gram that one suffix array holds, at most
STEP = 64
CHUNK = 1 << 18  # bytes handled at once when anchors are chosen
WORD_GRAM = 16  # words, a power of two
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` values from every position (by doubling)."""
    h, size, power = data.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` keys from every position (by doubling)."""
    low, size = keys, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:len(keys) - width + 1], low[width - size:len(keys) - size + 1]) if size < width else low


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, first bytes, ends) of the anchors of all windows of
    ``length`` bytes that lie within one of the texts ``data[offsets[i]:offsets[i + 1]]``;
    first and end are those of the union of the windows that chose the anchor."""
    found: list[tuple] = []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        first, own = int(offsets[i]), offsets[i:j + 1] - offsets[i]
        # a longer text goes piece by piece, each with the windows that start in it
        for start in range(0, max(int(own[-1]) if j == i + 1 else 1, 1), CHUNK):
            stop = int(own[-1]) if j > i + 1 else min(start + CHUNK + length - 1, int(own[-1]))
            part = data[first + start:first + stop]
            if len(part) < length:
                continue
            h = _gram_hashes(part)
            key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            at = (_window_minimum(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            window = np.arange(len(at))
            if j > i + 1:  # windows that cross the end of a text do not count
                inside = np.zeros(len(at), bool)
                for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
                    if b - a >= length:
                        inside[a:b - length + 1] = True
                at, window = at[inside], window[inside]
            if len(at):  # the windows of an anchor follow each other
                edge = np.flatnonzero(np.diff(at)) + 1
                low, high = np.append(0, edge), np.append(edge - 1, len(at) - 1)
                base = first + start
                found.append((at[low] + base, h[at[low]].view(np.int64), window[low] + base, window[high] + base + length))
        i = j
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, grams, low, high = (np.concatenate(x) for x in zip(*found))
    places, keep, owner = np.unique(at, return_index=True, return_inverse=True)
    first, end = low[keep].copy(), high[keep].copy()
    np.minimum.at(first, owner, low)  # an anchor at the border of two pieces
    np.maximum.at(end, owner, high)
    return places, grams[keep], first, end


# --- passages ------------------------------------------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, ends, hashes) of the words `[^\\x20\\x09-\\x0D]+` of ``data``."""
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return first, end, np.zeros(0, np.uint64)
    size = end - first
    powers = np.full(int(size.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    values = (data[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * powers[place]
    return first, end, _mixed(np.add.reduceat(values, np.cumsum(size) - size))


def word_anchors(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every window of ``words`` words that lies within one of the texts
    ``data[offsets[i]:offsets[i + 1]]``: its text's number, its first byte and its end in
    ``data``, and the hash of its anchor; some texts at a time."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        base = int(offsets[i])
        # a byte of white space parts the texts
        spread = np.full(int(offsets[j]) - base + j - i, 0x20, np.uint8)
        text = np.repeat(np.arange(i, j), np.diff(offsets[i:j + 1]))
        spread[np.arange(len(text)) + text - i] = data[base:int(offsets[j])]
        first, end, hashes = _words(spread)
        if len(first) >= words:
            h = _gram_hashes(hashes, WORD_GRAM)
            key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            at = (_window_minimum(key, words - WORD_GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            own = np.searchsorted(offsets[i:j + 1] - base + np.arange(j - i + 1), first, side="right") - 1
            inside = own[:len(at)] == own[words - 1:]
            own = own[:len(at)][inside]
            yield own + i, first[:len(at)][inside] - own + base, end[words - 1:][inside] - own + base, h[at[inside]].view(np.int64)
        i = j


# --- the interval tree ---------------------------------------------------------

def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class SuffixArray:
    """Enhanced suffix array of strings: their order and the common prefixes of
    neighbours in it."""

    def __init__(self, strings: list[bytes]):
        self.order = sorted(range(len(strings)), key=strings.__getitem__)
        self.lcp = [0] + [_common_prefix(strings[a], strings[b]) for a, b in zip(self.order, self.order[1:])]
        self.rank = [0] * len(strings)
        for r, i in enumerate(self.order):
            self.rank[i] = r


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an LCP array: (depth, first, last) of every common-prefix
    interval of two or more suffixes, children before parents."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if i < len(lcp) and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Repeat groups among occurrences (bytes before the anchor, bytes from it on):
    (bytes to the left, bytes to the right, all occurrences), where the occurrences
    share exactly that many bytes around the anchor, ``length`` or more in sum, and
    neither side can be extended for all of them."""
    if len(contexts) == 2:
        (a, b), (c, d) = contexts
        common, depth = _common_prefix(a[::-1], c[::-1]), _common_prefix(b, d)
        if common + depth >= length:
            yield common, depth, [0, 1]
        return
    right = SuffixArray([r for _, r in contexts])
    left = SuffixArray([x[::-1] for x, _ in contexts])
    n = len(contexts)
    # common suffixes of left contexts: minima of left.lcp between ranks (sparse table)
    levels = [np.array(left.lcp, np.int64)]
    while 2 << (len(levels) - 1) <= n:
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    ranks = np.array([left.rank[i] for i in right.order], np.int64)
    for depth, first, last in intervals(right.lcp):
        need = length - depth
        own = np.argsort(ranks[first:last + 1], kind="stable") + first
        r = ranks[own]
        log = np.frexp((r[1:] - r[:-1]).astype(np.float64))[1] - 1
        shared = np.empty(len(r) - 1, np.int64)
        for k in np.unique(log).tolist():
            pick = log == k
            shared[pick] = np.minimum(levels[k][r[:-1][pick] + 1], levels[k][r[1:][pick] - (1 << k) + 1])
        if shared.max() < need:
            continue
        # left extensions inside the interval: its own intervals over the left order
        for common, a, b in intervals([0, *shared.tolist()]):
            if common >= need:
                members = own[a:b + 1]
                # maximal to the right only if no deeper right interval holds all of them
                if _depth(right.lcp, int(members.min()), int(members.max())) == depth:
                    yield common, depth, [right.order[i] for i in members.tolist()]


def _depth(lcp: list[int], first: int, last: int) -> int:
    return min(lcp[first + 1:last + 1])


# --- Spark ---------------------------------------------------------------------

ANCHORS = "gram long, context long, doc_id long, t long, at int, before int, after int"
SPANS = "doc_id long, t long, first int, last int"
KEY = ["doc_id", "t"]
REPORT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows with equal id and text are one to all that follows; t stands for the text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            at, gram, first, end = anchors(data, offsets, length)
            doc = np.searchsorted(offsets, at, side="right") - 1
            raw = memoryview(data.tobytes())
            digest = xxhash.xxh3_64_intdigest
            # the hash holds the anchor's place in the context too
            context = np.fromiter((digest(raw[a:b], c - a) for a, b, c in zip(first.tolist(), end.tolist(), at.tolist())), np.uint64, len(at)).view(np.int64)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), batch.column(0).take(own), batch.column(2).take(own), *(pa.array(x, pa.int32()) for x in (at - offsets[doc], at - first, end - at))], [c.split()[0] for c in ANCHORS.split(", ")])

    return texts.mapInArrow(lean(run), ANCHORS)


def _tree_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the occurrences of grams with at most GROUP contexts (sorted by gram)."""
    def spans(rows: list[dict]) -> Iterator[tuple]:
        sides = [(r["text"][:r["before"]], r["text"][r["before"]:]) for r in rows]
        low, high = [None] * len(rows), [None] * len(rows)
        for left, right, members in maximal_repeats(sides, length):
            for m in members:  # repeats of one anchor all hold it: their union is one span
                low[m] = left if low[m] is None else max(low[m], left)
                high[m] = right if high[m] is None else max(high[m], right)
        for r, x, y in zip(rows, low, high):
            if x is not None:
                yield r["doc_id"], r["t"], r["at"] - x, r["at"] + y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            made: list[tuple] = []
            for row in batch.to_pylist():
                if group and group[-1]["gram"] != row["gram"]:
                    made += spans(group)
                    group = []
                group.append(row)
            yield _span_batch(made)
        if group:
            yield _span_batch(list(spans(group)))

    return contexts.mapInArrow(lean(run), SPANS)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in SPANS.split(", ")])


PIECES = "h1 long, h2 long, doc_id long, t long, first int, text binary"


def _pieces(contexts: DataFrame, length: int) -> DataFrame:
    """Keys of ``length - STEP + 1`` bytes at every STEP bytes before each anchor, with
    the piece of text that holds the windows around the key."""
    size = length - STEP + 1

    def rows(r: dict) -> Iterator[tuple]:
        text, at, first = r["text"], r["before"], r["at"] - r["before"]
        for q in range(at, -1, -STEP):
            if q + size <= len(text):
                digest = xxhash.xxh3_128_intdigest(text[q:q + size], at - q)
                low = max(0, q - STEP + 1)
                yield *_halves(digest), r["doc_id"], r["t"], first + low, text[low:q + length]

    return _exploded(contexts, rows, PIECES)


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """The hash of every window of ``length`` bytes of the pieces."""
    def rows(r: dict) -> Iterator[tuple]:
        text = r["text"]
        for a in range(len(text) - length + 1):
            yield *_halves(xxhash.xxh3_128_intdigest(text[a:a + length])), r["doc_id"], r["t"], r["first"] + a

    return _exploded(pieces, rows, PIECES.removesuffix(", text binary"))


def _halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _exploded(rows: DataFrame, make, schema: str) -> DataFrame:
    """Every row of ``rows`` as the rows ``make`` gives for it, in bounded batches."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                out = [x for r in batch.slice(k, 512).to_pylist() for x in make(r)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(lean(run), schema)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose hash occurs twice or more."""
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return rows.join(twice, ["h1", "h2"], "left_semi")


def _on_key(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on the document key (a null id equals a null id); columns of ``b`` but the key are added."""
    b = b.select(*(F.col(k).alias(f"__{k}") if k in KEY else F.col(k) for k in b.columns))
    return a.join(b, (a["t"] == b["__t"]) & a["doc_id"].eqNullSafe(b["__doc_id"]), how).drop("__t", "__doc_id")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(spans, texts) of all texts that hold a repeated string of ``length`` bytes.

    spans: doc_id, t (a hash of the text) and the array of (first, last) byte spans
    that such strings cover, unordered, they may overlap. texts: the same key and the
    text, at least for every text with spans.
    """
    spark = prepared(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    every = stored(_anchor_rows(texts, length), "anchors")
    # a table of its own, so that the join deals out both sides and can split a gram with very many rows
    twice = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated-grams")
    marks = stored(every.join(twice, "gram", "left_semi"), "repeated-anchors")
    release(spark)
    counts = stored(marks.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "at")).alias("one")), "contexts")
    # what occurs once need only be compared where its gram has other contexts; tables of their own, for the same reason
    grams = stored(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")), "grams")
    known = counts.join(grams, "gram")
    compare = F.when((F.col("contexts") > 1) & (F.col("least") == 1), F.struct(*KEY, "at").eqNullSafe(F.col("one"))).otherwise(F.lit(False))
    found = marks.join(known, ["gram", "context"]).select(*KEY, F.struct("gram", "at", "before", "after", (F.col("n") > 1).alias("copy"), compare.alias("compare"), (F.col("contexts") > group).alias("hot")).alias("a")).where("a.copy or a.compare")
    per_text = found.groupBy(*KEY).agg(F.collect_set("a").alias("anchors"))
    held = stored(_on_key(texts, per_text, "inner"), "repeat-texts")
    release(spark)
    anchor = held.select(*KEY, F.explode("anchors").alias("a"), F.col("text").cast("binary").alias("text"))
    contexts = anchor.where("a.compare").select(*KEY, "a.gram", "a.hot", "a.at", "a.before", F.expr("substring(text, a.at - a.before + 1, a.before + a.after)").alias("text"))
    # repeated rows bring a context twice; equal contexts of one gram are one anyway
    cold = _tree_spans(contexts.where("not hot").repartition("gram").sortWithinPartitions("gram"), length)
    copies = held.select(*KEY, F.explode("anchors").alias("a")).where("a.copy").selectExpr(*KEY, "a.at - a.before as first", "a.at + a.after as last")
    pieces = stored(_repeated(stored(_pieces(contexts.where("hot"), length), "pieces")), "pieces-twice")
    windows = _repeated(stored(_windows(pieces, length), "windows")).select(*KEY, "first", (F.col("first") + length).alias("last"))
    spans = copies.union(cold).union(windows)
    grouped = stored(spans.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    release(spark)
    return grouped, held.select(*KEY, "text")


WINDOWS = "h1 long, h2 long, doc_id long, t long, first int, last int, lead int"


def _word_grams(texts: DataFrame, words: int) -> DataFrame:
    """The anchors of every text's windows, each once a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            for own, _, _, gram in word_anchors(data, offsets, words):
                order = np.lexsort((gram, own))
                own, gram = own[order], gram[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])
                rows = pa.array(own[new])
                yield pa.RecordBatch.from_arrays([pa.array(gram[new]), batch.column(0).take(rows), batch.column(2).take(rows)], ["gram", *KEY])

    return texts.mapInArrow(lean(run), "gram long, doc_id long, t long")


def _word_windows(held: DataFrame, words: int) -> DataFrame:
    """The windows of every text of ``held`` whose anchors are among its ``grams``; lead
    is 1 for the first of a row's equal windows, else 0."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, offsets = utf8_buffers(row.column(2))
                grams = row.column(3)[0].values.to_numpy()
                raw = data.tobytes()
                for _, first, end, gram in word_anchors(data, offsets, words):
                    pick = np.isin(gram, grams)
                    first, end = first[pick], end[pick]
                    if not len(first):
                        continue
                    digests = b"".join(xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) for a, b in zip(first.tolist(), end.tolist()))
                    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    lead = np.zeros(len(first), np.int32)
                    lead[np.unique(np.frombuffer(digests, "V16"), return_index=True)[1]] = 1
                    same = pa.array(np.zeros(len(first), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), row.column(0).take(same), row.column(1).take(same), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(lead)], names)

    return held.mapInArrow(lean(run), WINDOWS)


def passage_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51, holders: int = 3) -> DataFrame:
    """doc_id, t and spans, as of ``repeated_spans``, of all runs of ``words`` words (16 or
    more) that ``holders`` rows or more hold; white space between words may differ."""
    spark = prepared(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    every = _word_grams(texts, words)
    shared = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= holders).select("gram"), "passage-grams")
    release(spark)
    per_text = stored(every.join(shared, "gram", "left_semi").groupBy(*KEY).agg(F.collect_set("gram").alias("grams")), "passage-texts")
    release(spark)
    held = _on_key(texts, per_text, "inner").select(*KEY, "text", "grams")
    windows = stored(_word_windows(held, words), "passage-windows")
    release(spark)
    many = windows.groupBy("h1", "h2").agg(F.sum("lead").alias("n")).where(F.col("n") >= holders).select("h1", "h2")
    spans = windows.join(many, ["h1", "h2"], "left_semi")
    grouped = stored(spans.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "passage-spans")
    release(spark)
    return grouped


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint spans, in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining text of every
    row of ``docs`` (in the text, a character of which bytes are removed is left out)."""
    spans, _ = repeated_spans(docs, length=length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                raw, runs = text.encode(), merged(found)
                if runs:
                    edges = [0, *(e for run in runs for e in run), len(raw)]
                    left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    rows.append((doc, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
                else:
                    rows.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text))
            types = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], REPORT)

    joined = _on_key(_texts(docs, "doc_id", "text"), spans, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int | None = None, holders: int = 3) -> DataFrame:
    """``docs`` with every repeated span cut out of its text, and a last column
    ``n_removed`` (bytes), in place of any of this name. A character that a span covers
    only in part stays. With ``words``, runs of so many words that ``holders`` rows or
    more hold go too, both judged on the whole texts."""
    docs = docs.drop("n_removed")
    passages = passage_spans(docs, id_col, text_col, words, holders) if words else None
    spans, _ = repeated_spans(docs, id_col, text_col, length)
    if passages is not None:
        spans = spans.union(passages).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    own = spans.select(F.col("doc_id").alias("__d"), F.col("t").alias("__u"), F.col("spans").alias("__spans"))
    joined = keyed.join(own, keyed["__id"].eqNullSafe(own["__d"]) & (keyed["__t"] == own["__u"]), "left").select(*docs.columns, "__spans")
    names = docs.columns
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                new = _without(text, merged(spans)) if spans else text
                texts.append(new)
                sizes.append(len((text or "").encode()) - len((new or "").encode()))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], [*names, "n_removed"])

    return joined.mapInArrow(lean(cut), T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())]))


def _without(text: str, runs: list[tuple[int, int]]) -> str:
    raw = text.encode()
    inner = []
    for a, b in runs:  # borders move inwards to whole characters
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        inner.append((a, b))
    edges = [0, *(e for run in inner for e in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
