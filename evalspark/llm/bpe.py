"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each task holds its texts' distinct pieces (matches of the tokenizer's pattern) in an
in-memory DuckDB. A piece is one row: the list of its tokens, at first its bytes, and
the list of the ranks of its pairs. One step of the recursive query finds every piece's
leftmost pair of minimum rank, puts the merged token in its place and looks up the ranks
of the two pairs that changed; a piece without a mergeable pair is finished. Decoding
picks each document's tokens, in their order, from the list of the vocabulary and joins
their bytes.

The merge table follows from the ranks alone: two tokens merge where their bytes
together are a token, and that token's rank is the pair's. A piece that is a token
as a whole is that token, as the public library has it.

Null and empty texts have no ids and decode to nothing. Pieces of more than
``LONG_PIECE`` bytes (no pattern match in ordinary text is that long) are contracted
in the same order with a heap, for one step of the query a byte would be quadratic.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepared, ragged

BATCH_CHARS = 2_000_000   # of text that a task encodes at once (a longer text: alone)
ROWS = 1_000_000          # list entries of all steps of one recursive query, about (a piece of n bytes: n * n / 2)
KNOWN = 400_000           # pieces whose tokens a worker remembers; then it begins anew
LONG_PIECE = 512
MEMORY = "400MB"          # of a task's DuckDB, which writes no files: ROWS bounds what it holds
NONE = (1 << 31) - 1      # the rank of a pair that is no token, and the token before and after a piece

CONTRACT = f"""
with recursive step(piece, tokens, ranks, least) as (
    select piece, tokens, ranks, list_min(ranks) from words
  union all
    select piece, tokens, ranks, list_min(ranks)
    from (select piece, list_concat(tokens[:i], [least], tokens[i + 3:]) as tokens,
                 list_concat(ranks[:i - 1], [coalesce(b.rank, {NONE}), coalesce(a.rank, {NONE})], ranks[i + 3:]) as ranks
          from (select *, list_position(ranks, least) - 1 as i from step where least < {NONE})
          left join merges b on b.pair = (tokens[i]::bigint << 32) | least
          left join merges a on a.pair = (least::bigint << 32) | tokens[i + 3])
)
select tokens[2:-2] as tokens from step where least = {NONE} order by piece
"""
DECODE = "select doc, array_to_string(list_select((select list(symbols order by token) from vocabulary), list_transform(tokens, lambda t: t + 1)), '') as text from ids"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank (its id) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The pattern compiled with white space as Unicode has it, as the public library reads it."""
    import regex

    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class _Numbers(dict):
    """key -> its rank in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, splitter(pattern).findall
        self._forget()
        self.byte_tokens = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.byte_pairs = np.full((257, 257), NONE, np.int32)  # 256: the border of a piece
        for t, r in ranks.items():
            if len(t) == 2 and t[:1] in ranks and t[1:] in ranks:
                self.byte_pairs[t[0], t[1]] = r
        merges = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        symbols: list = [None] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            symbols[r] = "".join(chr(256 + b) for b in t)
        self.tables = {
            "merges": pa.table({"pair": pa.array([p for p, _ in merges], pa.int64()), "rank": pa.array([r for _, r in merges], pa.int32())}),
            # a byte b is the symbol U+0100 + b, so that tokens that are no whole characters are texts too; an id that no token has: null
            "vocabulary": pa.table({"token": np.arange(len(symbols), dtype=np.int32), "symbols": pa.array(symbols, pa.string())}),
        }
        self._db = None

    @property
    def db(self):
        """The database, with its tables; opened when it is first used after :meth:`close`."""
        if self._db is None:
            import duckdb

            self._db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
            for name, rows in self.tables.items():
                self._db.register("loaded", rows)
                self._db.execute(f"create table {name} as select * from loaded")
                self._db.unregister("loaded")
        return self._db

    def close(self) -> None:
        """Close the database, whose buffers outlast its queries; known pieces stay."""
        if self._db is not None:
            self._db.close()
            self._db = None

    def _contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces one after another, number of tokens of each)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(sizes + 2)])  # a piece lies between two borders
        data = np.full(starts[-1], 256, np.int64)
        data[ragged(starts[:-1] + 1, sizes)] = np.frombuffer(b"".join(pieces), np.uint8)
        tokens = np.append(self.byte_tokens, np.int32(NONE))[data]
        if (tokens[:-1][tokens[1:] != NONE] < 0).any():
            raise ValueError("a byte that is no token has no pairs")
        ranks = self.byte_pairs[data[ragged(starts[:-1], sizes + 1)], data[ragged(starts[:-1] + 1, sizes + 1)]]
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))
        self.db.register("words", pa.table({"piece": np.arange(len(pieces), dtype=np.int32), "tokens": lists(tokens, sizes + 2), "ranks": lists(ranks, sizes + 1)}))
        made = self.db.sql(CONTRACT).to_arrow_table().column("tokens").combine_chunks()
        self.db.unregister("words")
        return made.flatten().to_numpy(), made.value_lengths().to_numpy()

    def _contract_long(self, piece: bytes) -> list[int]:
        """One piece, contracted leftmost pair of minimum rank first, with a heap."""
        tokens: list = [bytes([b]) for b in piece]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        ranks = self.ranks
        heap = [(ranks[tokens[i] + tokens[i + 1]], i, tokens[i] + tokens[i + 1]) for i in range(len(piece) - 1) if tokens[i] + tokens[i + 1] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if tokens[i] is not None else len(piece)
            if j >= len(piece) or tokens[i] + tokens[j] != pair:
                continue  # one of the two has been merged since
            tokens[i], tokens[j], after[i] = pair, None, after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(piece) and tokens[a] + tokens[b] in ranks:
                    heapq.heappush(heap, (ranks[tokens[a] + tokens[b]], a, tokens[a] + tokens[b]))
        return [ranks[t] for t in tokens if t is not None]

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces one after another, number of tokens of each)."""
        found: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                found[i] = (rank,)
            elif len(p) > LONG_PIECE:
                found[i] = self._contract_long(p)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))  # pieces of like length take like numbers of steps
        held = np.cumsum([len(pieces[i]) * (len(pieces[i]) + 1) // 2 for i in rest]) // ROWS
        for own in (rest[a:b] for a, b in pairwise([0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(rest)]) if b > a):
            tokens, sizes = self._contract([pieces[i] for i in own])
            ends = np.cumsum(sizes)
            for i, a, b in zip(own, (ends - sizes).tolist(), ends.tolist()):
                found[i] = tokens[a:b]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.asarray(f, np.int32) for f in found]) if found else np.zeros(0, np.int32), sizes

    def _forget(self) -> None:
        self.known = _Numbers()  # piece -> its number
        self.tokens, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)  # of all known pieces

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.known) > KNOWN:
            self._forget()
        index, had = self.known, len(self.known)
        number = index.__getitem__
        refs = [np.fromiter(map(number, self.find(t)) if t else (), np.int32) for t in texts]
        new = [p.encode() for p in islice(index, had, None)]
        tokens, sizes = self.pieces(new)
        self.tokens, self.sizes = np.concatenate([self.tokens, tokens]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        use = np.concatenate(refs) if refs else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(self.sizes[use])])
        counts = np.array([len(r) for r in refs], np.int64)
        stops = np.cumsum(counts)
        return self.tokens[ragged(starts[use], self.sizes[use])], ends[stops] - ends[stops - counts]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each run of ``lengths`` ids."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        self.db.register("ids", pa.table({"doc": np.arange(len(lengths), dtype=np.int32), "tokens": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))}))
        made = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(lengths)
        for doc, text in zip(made.column("doc").to_pylist(), made.column("text").to_pylist()):
            out[doc] = text.encode("utf-16-le")[::2]
        return out


_CODECS: list[tuple[dict, str, Codec]] = []  # of this worker: at most one, kept from task to task


def _codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    if not _CODECS or _CODECS[0][0] is not ranks or _CODECS[0][1] != pattern:
        _CODECS[:] = [(ranks, pattern, Codec(ranks, pattern))]
    return _CODECS[0][2]


def _slices(batch: pa.RecordBatch, texts: list) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in runs of about ``BATCH_CHARS`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, size = i + 1, 0


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the last columns ids (array<int>) and decoded (binary); they take
    the place of columns of these names."""
    docs = docs.drop("ids", "decoded")
    spark = prepared(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        try:
            for batch in batches:
                codec = codec or _codec(shipped.value, pattern)
                for part, texts in _slices(batch, batch.column(at).to_pylist()):
                    ids, lengths = codec.encode(texts)
                    decoded = codec.decode(ids, lengths)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.binary())], [*names, "ids", "decoded"])
        finally:
            if codec:
                codec.close()

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of :func:`encode_and_decode`'s rows."""
    return encoded.select(F.col(id_col).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
