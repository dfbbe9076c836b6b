"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints
that differ in at most two bits agree on some whole segment, and on the segment
after it they differ in at most two bits. Decoding that next segment and each of
its one-bit neighbours with the perfect binary Golay code (23, 12, 7) gives one to
six codeword indices, and two words within two bits always share one of them (they
have a common one-bit neighbour, which decodes to one codeword). A key is the
agreeing segment and one such index.

Fingerprints that share a key with another one are candidates. Verification is
exact and makes no pairs: two fingerprints are within two bits if and only if they
share a point at distance of one or less, so every candidate is sent to its 65
points and the (at most 65) fingerprints that meet at a point are linked to the
smallest of them.

Copies meet as one fingerprint before any of this, so a large group of copies is a
single row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepared, stored, utf8_views
from .components import components

SEGMENTS = (22, 21, 21)
# Fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
MAX_BITS = 2


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the ``shingle``-word shingles of a text (lower-cased A-Z, words
    between ASCII white space, repeats counted; fewer words: the whole sequence;
    no word: zero), hashed with XXH64, seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    n = max(len(words) - shingle + 1, 1)
    last = ends[-1:] if len(words) < shingle else ends[shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):  # bit counts in bounded pieces, however long the text
        ones += np.unpackbits(hashes[k:k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with its fingerprint as a (signed) long in a last column ``name``."""
    prepared(docs.sparkSession)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in utf8_views(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(lean(add), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


@cache
def _corrections() -> np.ndarray:
    """Syndrome (11 bits) -> the error of weight three or less that has it."""
    table = np.zeros(1 << 11, np.int64)
    bits = [0] + [1 << i for i in range(23)]
    errors = np.unique([a ^ b ^ c for a in bits for b in bits for c in bits])
    table[_syndromes(errors)] = errors
    return table


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ (GOLAY << (k - 11)), rest)
    return rest


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """The 12-bit index (systematic part) of the codeword nearest to each 23-bit word."""
    return (words ^ _corrections()[_syndromes(words)]) >> 11


def fuzzy_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and of its one-bit neighbours, one row a word;
    repeated indices are -1."""
    flips = np.array([0] + [1 << i for i in range(width)], np.int64)
    found = np.sort(nearest_codeword(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fuzzy keys of unsigned 64-bit fingerprints."""
    values, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        values.append((prints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1))
    rows, keys = [], []
    for i in range(len(SEGMENTS)):
        j = (i + 1) % len(SEGMENTS)
        indices = fuzzy_indices(values[j], SEGMENTS[j])
        row, col = np.nonzero(indices >= 0)
        rows.append(row)
        keys.append((i << 34) | (values[i][row] << 12) | indices[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _arrow_pairs(prints: DataFrame, make, names: tuple[str, str]) -> DataFrame:
    """Rows (made value, fingerprint) of ``make`` over the fingerprint column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(own), 8192):
                row, value = make(own[k:k + 8192].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(own[k:k + 8192][row])], list(names))

    return prints.mapInArrow(lean(run), f"{names[0]} long, {names[1]} long")


def _points(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, point) of the fingerprints themselves and their 64 one-bit neighbours."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return np.repeat(np.arange(len(prints)), 65), (prints[:, None] ^ flips).ravel().view(np.int64)


def links(prints: DataFrame, col: str = "fingerprint") -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``prints`` that differ in
    at most two bits: not every pair, but the same components."""
    spark = prepared(prints.sparkSession)
    distinct = stored(prints.select(F.col(col).alias("f")).distinct(), "fingerprints")
    keys = _arrow_pairs(distinct, golay_keys, ("k", "f"))
    shared = keys.groupBy("k").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a <> b").select("k")
    candidates = keys.join(shared, "k", "left_semi").select("f").distinct()
    points = _arrow_pairs(candidates, _points, ("z", "f"))
    met = points.groupBy("z").agg(F.sort_array(F.collect_list("f")).alias("m")).where(F.size("m") > 1)
    return met.select(F.col("m")[0].alias("u"), F.explode(F.slice("m", 2, 64)).alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    whose fingerprint is reachable over links of at most two differing bits.

    A null or empty text has fingerprint zero and is linked like any other. Rows
    with a null doc_id take part; they never name a component (component_id is null
    where no row of it has an id). Repeated rows each get their row.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    prints = stored(with_fingerprint(ids, "__text", shingle).select("doc_id", "fingerprint"), "simhash")
    named = group_ids(prints).select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def group_ids(prints: DataFrame) -> DataFrame:
    """(fingerprint, root, component_id) for every fingerprint of ``prints`` (doc_id,
    fingerprint); root is the component's smallest fingerprint."""
    least = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-least")
    roots = components(links(least))
    rooted = least.join(roots, least["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the
    smallest id (of rows that repeat it, one; without any id in the component, one
    row). Rows are numbered in the written table; numbers, ids and fingerprints are
    compared, and a text moves once, to its number."""
    mark, row = "__fingerprint", "__row"
    marked = stored(with_fingerprint(docs, text_col, shingle, mark).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    small = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(mark).alias("fingerprint"), row)
    named = group_ids(small).select("fingerprint", "root")
    first = small.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("s"))
    stays = first.join(named, "fingerprint").groupBy("root").agg(F.min("s").alias("s")).select(F.col(f"s.{row}").alias(row))
    return marked.join(stays, row, "left_semi").select(docs.columns)
