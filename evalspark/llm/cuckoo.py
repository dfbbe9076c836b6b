"""Exact deduplication over a cuckoo-filter index of live digests.

A text is normalised (every run of ``[\\x20\\x09-\\x0D]`` is one space; null is empty) and
stands for its signature: SHA-256, XXH64 and length of the normalised UTF-8. The index is
cut into shards by the signature's hash. A shard is a cuckoo filter (two candidate buckets
of four slots, 16-bit fingerprints) over an entry table with the signatures in full, the
smallest id and the number of copies. A fingerprint that matches is only a hit; it
counts once the entry's whole signature is equal. When insertion runs out of kicks the
shard doubles its buckets and places all entries again from their stored signatures. A
signature whose last copy is deleted leaves the filter, and its slot and entry are free.

Two tables make an index: ``members`` (signature, id, copies) and ``index`` (a row for a
shard's slots and one for each entry). :func:`build`, :func:`insert` and :func:`delete`
write new ones and leave the old as they are, so a job that dies half way costs nothing.

Hot groups: equal rows are counted before anything moves, signatures of one Arrow batch
are merged before they go to their shard, so a group with a third of all rows sends one
row a batch; texts never move. The join that gives members their group has the
index on one side, a row a signature, and splits a hot signature.

Defined results: a null or empty text is the empty text; null ids lose against any id;
of rows that repeat id and text exactly one is kept; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, shared_path

BLANK_RUN = r"[\x20\x09-\x0D]+"
SLOTS, KICKS, FIRST_BUCKETS = 4, 200, 16
WIDTH = 48  # bytes of a signature: SHA-256, XXH64, length
# kinds of the rows that a shard reads, in this order: its slots, its entries, changes
FILTER, ENTRY, ADD, SET = 0, 1, 2, 3
INDEX = "shard int, kind int, entry int, signature binary, keep_id long, copies long, buckets int, slots binary"


class CuckooIndex:
    """The filter of one shard and its entries."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.signatures, self.keep_ids, self.copies = bytearray(), [], []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * buckets * SLOTS))  # 0: a free slot
        self.entries = array("I", bytes(4 * buckets * SLOTS))
        self.turn = 0

    def _place(self, signature: bytes) -> tuple[int, int]:
        """(fingerprint, first bucket)."""
        return int.from_bytes(signature[:2], "little") or 1, int.from_bytes(signature[2:10], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def signature(self, entry: int) -> bytes:
        return bytes(self.signatures[entry * WIDTH:(entry + 1) * WIDTH])

    def _slot(self, signature: bytes) -> int | None:
        """The slot whose fingerprint hits and whose stored signature is equal."""
        mark, bucket = self._place(signature)
        for b in {bucket, self._other(bucket, mark)}:
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == mark and self.signature(self.entries[s]) == signature:
                    return s
        return None

    def find(self, signature: bytes) -> int | None:
        """The live entry of ``signature``."""
        slot = self._slot(signature)
        return None if slot is None else self.entries[slot]

    def _seat(self, entry: int) -> bool:
        """Put an entry into the filter; False where the kicks run out (one fingerprint
        is without a slot then, and the filter has to be made anew)."""
        mark, bucket = self._place(self.signature(entry))
        for kick in range(KICKS):
            for b in (bucket, self._other(bucket, mark)) if kick == 0 else (bucket,):
                for s in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.entries[s] = mark, entry
                        return True
            self.turn += 1
            s = bucket * SLOTS + self.turn % SLOTS
            mark, entry, self.prints[s], self.entries[s] = self.prints[s], self.entries[s], mark, entry
            bucket = self._other(bucket, mark)
        return False

    def live(self) -> list[int]:
        gone = set(self.free)
        return [e for e in range(len(self.copies)) if e not in gone]

    def _grow(self) -> None:
        """Double the buckets, again if need be, and seat all entries from their signatures."""
        entries = self.live()
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(map(self._seat, entries)):
                return

    def add(self, signature: bytes, keep_id: int | None, copies: int) -> None:
        """Insert ``copies`` rows of ``signature``, of which ``keep_id`` is the smallest id."""
        entry = self.find(signature)
        if entry is not None:
            had = self.keep_ids[entry]
            self.keep_ids[entry] = keep_id if had is None else had if keep_id is None else min(had, keep_id)
            self.copies[entry] += copies
            return
        if self.free:
            entry = self.free.pop()
            self.signatures[entry * WIDTH:(entry + 1) * WIDTH] = signature
            self.keep_ids[entry], self.copies[entry] = keep_id, copies
        else:
            entry = len(self.copies)
            self.signatures += signature
            self.keep_ids.append(keep_id)
            self.copies.append(copies)
        if not self._seat(entry):
            self._grow()

    def set(self, signature: bytes, keep_id: int | None, copies: int) -> None:
        """What is left of ``signature`` after a deletion; without copies it goes."""
        slot = self._slot(signature)
        if slot is None:
            return
        entry = self.entries[slot]
        self.keep_ids[entry], self.copies[entry] = keep_id, copies
        if not copies:
            self.prints[slot] = 0
            self.free.append(entry)

    def stored(self) -> bytes:
        return self.prints.tobytes() + self.entries.tobytes()

    def load_slots(self, buckets: int, slots: bytes) -> None:
        n = buckets * SLOTS
        self._clear(buckets)
        self.prints, self.entries = array("H", slots[:2 * n]), array("I", slots[2 * n:])

    def load_entry(self, entry: int, signature: bytes, keep_id: int | None, copies: int) -> None:
        while len(self.copies) <= entry:  # entries come in order; a gap is a free one
            self.free.append(len(self.copies))
            self.signatures += bytes(WIDTH)
            self.keep_ids.append(None)
            self.copies.append(0)
        self.free.remove(entry) if self.free[-1] != entry else self.free.pop()
        self.signatures[entry * WIDTH:(entry + 1) * WIDTH] = signature
        self.keep_ids[entry], self.copies[entry] = keep_id, copies

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard as rows of the index table."""
        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        head = [[shard], [FILTER], [None], [None], [None], [None], [self.buckets], [self.stored()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, types)], names)
        live = self.live()
        for k in range(0, len(live), 50_000):
            own = live[k:k + 50_000]
            n = len(own)
            columns = [[shard] * n, [ENTRY] * n, own, [self.signature(e) for e in own], [self.keep_ids[e] for e in own], [self.copies[e] for e in own], [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, kind, entry) to the shards' new rows."""
    shard, index = None, CuckooIndex()
    for batch in batches:
        for at, kind, entry, signature, keep_id, copies, buckets, slots in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard:
                if shard is not None:
                    yield from index.rows(shard)
                shard, index = at, CuckooIndex()
            if kind == ADD:
                index.add(signature, keep_id, copies)
            elif kind == SET:
                index.set(signature, keep_id, copies)
            elif kind == ENTRY:
                index.load_entry(entry, signature, keep_id, copies)
            else:
                index.load_slots(buckets, slots)
    if shard is not None:
        yield from index.rows(shard)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of (signature, keep_id, copies) for each signature of a batch."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("signature").aggregate([("id", "min"), ("copies", "sum")])
        yield from found.select(["signature", "id_min", "copies_sum"]).rename_columns(["signature", "keep_id", "copies"]).to_batches()


@dataclass(frozen=True)
class Index:
    """The place of an index and its number of shards. A shard's entries (about 70 bytes
    each) are in one task's memory: choose ``shards`` by the distinct texts to come."""

    path: str
    shards: int

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("signature binary, id long, copies long").parquet(f"{self.path}/members")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def groups(self, spark: SparkSession) -> DataFrame:
        """signature, keep_id, copies of every live text."""
        return self.table(spark).where(F.col("kind") == ENTRY).select("signature", "keep_id", "copies")


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """signature, id, copies of the distinct rows."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"))
    parts = [F.unhex(F.sha2("text", 256)), F.unhex(F.lpad(F.hex(F.xxhash64("text")), 16, "0")), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0"))]
    return text.select(F.concat(*parts).alias("signature"), "id").groupBy("signature", "id").agg(F.count(F.lit(1)).alias("copies"))


def _changes(rows: DataFrame, kind: int, shards: int) -> DataFrame:
    """(signature, keep_id, copies) as rows for the shards."""
    shard = F.pmod(F.xxhash64("signature"), F.lit(shards)).cast("int")
    return rows.select(shard.alias("shard"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("entry"), "signature", "keep_id", "copies", F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("binary").alias("slots"))


def _write(index: Index, rows: DataFrame) -> Index:
    ordered = rows.repartition(index.shards, "shard").sortWithinPartitions("shard", "kind", "entry")
    ordered.mapInArrow(_shards, INDEX).write.parquet(f"{index.path}/index")
    return index


def _added(spark: SparkSession, members: DataFrame, shards: int) -> DataFrame:
    return _changes(members.mapInArrow(_merged, "signature binary, keep_id long, copies long"), ADD, shards)


def build(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of ``docs``; ``shards``: as many as the session has shuffle partitions."""
    spark = prepared(docs.sparkSession)
    index = Index(shared_path(spark, "cuckoo"), shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    _signed(docs, id_col, text_col).write.parquet(f"{index.path}/members")
    return _write(index, _added(spark, index.members(spark), index.shards))


def insert(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """``index`` with the rows of ``docs`` as well."""
    spark = prepared(docs.sparkSession)
    new = Index(shared_path(spark, "cuckoo"), index.shards)
    _signed(docs, id_col, text_col).write.parquet(f"{new.path}/inserted")
    added = spark.read.schema("signature binary, id long, copies long").parquet(f"{new.path}/inserted")
    together = index.members(spark).unionByName(added).groupBy("signature", "id").agg(F.sum("copies").alias("copies"))
    together.write.parquet(f"{new.path}/members")
    return _write(new, index.table(spark).unionByName(_added(spark, added, index.shards)))


def delete(index: Index, ids: DataFrame, id_col: str = "doc_id") -> Index:
    """``index`` without the documents whose id is in ``ids`` (all rows of that id; null
    ids delete nothing). The next smallest id takes the place of a deleted one that stayed."""
    spark = prepared(ids.sparkSession)
    new = Index(shared_path(spark, "cuckoo"), index.shards)
    gone = ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    members = index.members(spark)
    members.join(gone, "id", "left_anti").select("signature", "id", "copies").write.parquet(f"{new.path}/members")
    touched = members.join(gone, "id", "left_semi").select("signature").distinct()
    left = new.members(spark).join(touched, "signature", "left_semi").groupBy("signature").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("copies"))
    now = touched.join(left, "signature", "left").select("signature", "keep_id", F.coalesce("copies", F.lit(0)).alias("copies"))
    return _write(new, index.table(spark).unionByName(_changes(now, SET, index.shards)))


def decisions(index: Index, spark: SparkSession) -> DataFrame:
    """One row per live document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = index.groups(spark).withColumnRenamed("copies", "group_size")
    rows = index.members(spark).join(groups, "signature").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("signature", 1, 32))).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`decisions` over an index of ``docs``."""
    return decisions(build(docs, id_col=id_col, text_col=text_col), docs.sparkSession)


def oracle() -> str:
    return r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents),
ranked as (select *, row_number() over (partition by text order by doc_id nulls last) as place from texts),
groups as (select text, min(doc_id) as keep_id, count(*) as group_size from texts group by text)
select r.doc_id, g.keep_id, g.group_size, r.place = 1 as kept, sha256(r.text) as text_sha256
from ranked r join groups g using (text)
"""
