"""Token-id files: documents encoded with a public tokenizer and written as
Simple-8b coded shards.

The written table is one row per segment (whole documents, ``SEGMENT_IDS`` ids or a
little more, fewer at the end of an Arrow batch): the documents' ids and lengths, the packed words, the first word of
every block and the escaped values. Parts are consecutive ranges of doc_id, so
(part, segment, position) is ascending doc_id order and the offset of a document
in the whole id stream is known from the part totals alone.

Nulls: a null text is empty (only the end id is written); a null doc_id sorts
first. Rows that repeat a doc_id are all written, next to each other and in the order of
their texts' XXH64. An empty
table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import prepared, ragged, shared_path

SEGMENT_IDS = 1 << 20
END_ID = 1
SEGMENT_SCHEMA = ("part int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
                  "words binary, block_offsets binary, escapes binary")
# Letters whose lower case is the same letter by letter and that need no normalisation.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[ -&(-~À-ÖØ-öø-ÿ]*").fullmatch
_LETTER_RUN = re.compile(f"[{_LETTERS}]+").fullmatch
KNOWN = 700_000  # words whose ids a worker remembers; then it begins anew
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+").findall


def _byte_symbols() -> dict[int, str]:
    """Character -> the symbols that byte-level vocabularies write for its UTF-8 bytes:
    a printable Latin-1 byte is itself, the others follow from U+0100 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    symbol = {b: chr(b if b in shown else 256 + rest.index(b)) for b in range(256)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(128, 256)}


_SYMBOLS = _byte_symbols()


class _Index(dict):
    """key -> its rank in order of first sight."""

    def __missing__(self, key):
        self[key] = rank = len(self)
        return rank


class WordEncoder:
    """Whole texts to ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``
    of a tokenizer that drops white space: the ids of a text are those of its words,
    so each distinct word is encoded once. Words of plain letters, digits
    and symbols are taken apart further at the borders the tokenizer itself splits
    at; any other word goes to the tokenizer as it is."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self._forget()

    def _forget(self) -> None:
        self.known = _Index()  # word -> its number
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)  # ids of all known words

    def _ids(self, strings: list[str]) -> list[list[int]]:
        out: list = [None] * len(strings)
        rest = []
        for i, s in enumerate(strings):
            if _LETTER_RUN(s):  # one piece of the tokenizer: its model alone
                out[i] = [t.id for t in self.tokenizer.model.tokenize(s if s.isascii() else s.translate(_SYMBOLS))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        parts = _Index()
        rank = parts.__getitem__
        table = []
        for w in words:
            if _LETTER_RUN(w):
                table.append((rank(w),))
            elif _PLAIN(w) and not self.special(w):
                table.append([rank(p) for p in _PARTS(w.lower())])
            else:
                table.append([rank(w)])
        per_part = self._ids(list(parts))
        sizes = np.fromiter(map(len, per_part), np.int64, len(per_part))
        flat = np.fromiter(chain.from_iterable(per_part), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, table), np.int64, len(table))
        refs = np.fromiter(chain.from_iterable(table), np.int32, int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes[refs])])
        stops = np.cumsum(counts)
        return flat[ragged(starts[refs], sizes[refs])], ends[stops] - ends[stops - counts]

    def segments(self, texts: list[str | None], least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts of ``least`` ids or more (the last: fewer): (first text, end,
        their ids one after another, number of ids of each)."""
        if len(self.known) > KNOWN:
            self._forget()
        had, rank = len(self.known), self.known.__getitem__
        refs = [np.fromiter(map(rank, self._spaced(t).split(" ")), np.int32) for t in texts]
        new_flat, new_sizes = self.words(list(islice(self.known, had, None)))
        self.flat, self.sizes = np.concatenate([self.flat, new_flat]), np.concatenate([self.sizes, new_sizes])
        flat, sizes = self.flat, self.sizes
        starts = np.cumsum(sizes) - sizes
        lengths = np.fromiter((sizes[r].sum() for r in refs), np.int64, len(refs))
        first = held = 0
        for i, n in enumerate(lengths.tolist()):
            held += n
            if held >= least or i == len(refs) - 1:
                use = np.concatenate(refs[first:i + 1])
                yield first, i + 1, flat[ragged(starts[use], sizes[use])], lengths[first:i + 1]
                first, held = i + 1, 0

    def _spaced(self, text: str | None) -> str:
        """The text with spaces for line ends; in lower case if that is all the same."""
        text = (text or "").replace("\n", " ")
        return text.lower() if _PLAIN(text) and not self.special(text) else text


_ENCODERS: list[tuple[str, WordEncoder]] = []  # of this worker: at most one, kept from task to task


def _encoder(tokenizer_json: str) -> WordEncoder:
    if not _ENCODERS or _ENCODERS[0][0] != tokenizer_json:
        _ENCODERS[:] = [(tokenizer_json, WordEncoder(tokenizer_json))]
    return _ENCODERS[0][1]


def _segment(part: int, number: int, first: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    words, offsets, escapes = simple8b.encode(ids)
    cells = [part, number, first, len(ids), doc_ids, lengths.tolist(), words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode the texts of ``docs`` with the tokenizer file ``tokenizer`` (a path),
    append ``end_id`` to each and write them to ``path`` in ascending id order."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = prepared(docs.sparkSession).sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            encoder = _encoder(vocabulary.value)
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, lengths in encoder.segments(batch.column(1).to_pylist(), SEGMENT_IDS):
                whole = np.full(len(ids) + b - a, end_id, np.int32)
                whole[ragged(np.cumsum(lengths) - lengths + np.arange(b - a), lengths)] = ids
                yield _segment(part, number, first, doc_ids[a:b], lengths + 1, whole)
                number, first = number + 1, first + len(whole)

    key = F.col(id_col).cast("long")
    # rows that repeat an id go by their text's hash: the same order in every run, and ranges can split them
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    (rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
     .mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments under ``path`` with ``base``, the ids in all parts before."""
    segments = prepared(spark).read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # one row of 16 bytes per written partition, whatever the number of documents
    before = totals.selectExpr("part", "sum(part_ids) over (order by part) - part_ids as base")
    return segments.join(F.broadcast(before), "part")


def decoded(segments: DataFrame) -> DataFrame:
    """One row per document of the segments: doc_id, start, n_tokens, ids_crc32."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_offsets"], "<u4").astype(np.int64), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                raw = memoryview(ids.astype("<u4").tobytes())
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["first_id"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files and read them back (see :func:`decoded`)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return decoded(read_token_files(spark, path))
