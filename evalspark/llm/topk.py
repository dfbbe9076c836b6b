"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of like length. For a query with a
k-th best score so far of theta, a bucket whose longest vector has length l can hold a
better one only at a cosine of theta / (|q| l) or more, the bucket's local threshold:

* above 1 the bucket is skipped;
* otherwise vectors shorter than theta / |q| are cut off (length pruning: a prefix of
  the bucket, for it is sorted);
* from ``COORD`` on, the query's largest coordinates also bound the same coordinates of
  a candidate's direction (coordinate pruning).

What is left is verified by its exact integer product. theta starts with the k-th best
among the bucket of the longest vectors and grows as a task goes through its buckets,
longest first. Only candidates strictly below theta are dropped, so ties are whole.

Queries go in blocks of ``QUERIES``, buckets in tiles of ``TILE``. Every block meets the
first bucket (``BUCKET`` vectors, sent to every task); that gives its queries' thetas,
and with them the shortest length that may still matter to the block. A block is then
sent only to the tiles that have such vectors, a prefix for buckets are sorted; a tile's
vectors are sent once. A candidate is a row, so rows that repeat an id are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepared, stored

BUCKET = 2048    # vectors of a bucket
QUERIES = 512    # queries of a block
COORD = 0.3      # local cosine threshold from which coordinates prune as well
FOCUS = 4        # coordinates looked at
TILE = 16        # buckets of a tile
RECORDS = 4      # buckets or blocks that a Python worker gets at once
_EXACT = float(1 << 53)
BLOCK_SCHEMA = "block long, longest double, dims int, ids binary, rows binary, norms binary, vectors binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v, norm, row): floor(scale * x) of every vector without a null, infinite or NaN
    component, a row each, numbered. Rows without an id cannot be named and are left out."""
    good = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    one = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("row", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, norm, row) sorted by length, longest first, in blocks of ``size``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                lists = part.column(1).to_pylist()
                dims = max(map(len, lists))
                matrix = np.zeros((len(lists), dims))
                for i, v in enumerate(lists):  # a shorter vector has zeros behind
                    matrix[i, :len(v)] = v
                norms = part.column(2).to_numpy()
                cells = [number, float(norms[0]), dims, part.column(0).to_numpy().astype("<i8").tobytes(), part.column(3).to_numpy().astype("<i8").tobytes(), norms.astype("<f8").tobytes(), matrix.astype("<f8").tobytes()]
                number += 1
                types = [pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    # the row splits vectors of one length over partitions
    order = [F.col("norm").desc(), F.col("row")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK_SCHEMA)


class Block:
    """A block of vectors, longest first."""

    def __init__(self, row: dict):
        self.ids, self.rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows"))
        self.norms = np.frombuffer(row["norms"], "<f8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), row["dims"])
        self.units = self.vectors / np.where(self.norms > 0, self.norms, 1.0)[:, None]


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products (a shorter side has zeros behind)."""
    d = min(len(query), vectors.shape[1])
    query, vectors = query[:d], vectors[:, :d]
    top = float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * d
    if top < _EXACT:
        return (vectors @ query).astype(np.int64)
    exact = np.array([sum(int(a) * int(b) for a, b in zip(query, v)) for v in vectors], object)
    return np.array([max(min(x, (1 << 63) - 1), -(1 << 63)) for x in exact], np.int64)


def candidates(query: np.ndarray, norm: float, theta: float, block: Block) -> np.ndarray:
    """Rows of the block that may score ``theta`` or more with the query."""
    if theta <= 0 or norm == 0 or not len(block.ids):
        return np.arange(len(block.ids))
    slack = 1e-9
    local = theta / (norm * block.norms[0]) - slack if block.norms[0] > 0 else 2.0
    if local > 1:
        return np.zeros(0, np.int64)
    kept = int(np.searchsorted(-block.norms, -(theta / norm) * (1 - slack), side="right"))
    if local < COORD:
        return np.arange(kept)
    unit, angle = query / norm, np.arccos(local)
    inside = np.ones(kept, bool)
    for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
        own = block.units[:kept, f] if f < block.units.shape[1] else np.zeros(kept)
        at = np.arccos(np.clip(unit[f], -1.0, 1.0))
        inside &= (own >= np.cos(min(at + angle, np.pi)) - slack) & (own <= np.cos(max(at - angle, 0.0)) + slack)
    return np.nonzero(inside)[0]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:  # first cut off what lies below the k-th score
        at = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= at], scores[scores >= at]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _not_above(score: int) -> float:
    """``score`` as a float that is no larger."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


class Search:
    """The running top k of the queries of one block, of scores not below ``floor``."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()

    def add(self, block: Block) -> None:
        for i, (query, norm) in enumerate(zip(self.queries.vectors, self.queries.norms.tolist())):
            at = candidates(query, norm, float(self.floor[i]), block)
            if not len(at):
                continue
            # all rows: the bucket as it lies; some: copied out
            scores = products(query, block.vectors if len(at) == len(block.ids) else block.vectors[at])
            use = (block.rows[at] != self.queries.rows[i]) & (scores >= self.floor[i])
            if use.any():
                ids, scores = best(np.concatenate([self.top[i][0], block.ids[at][use]]), np.concatenate([self.top[i][1], scores[use]]), self.k)
                self.top[i] = ids, scores
                if len(ids) == self.k:
                    self.floor[i] = max(self.floor[i], _not_above(int(scores[-1])))

    def needed(self) -> float:
        """The shortest length that may hold a better candidate for some query."""
        norms = self.queries.norms
        return float(np.where((self.floor > 0) & (norms > 0), self.floor / np.where(norms > 0, norms, 1.0), 0.0).min(initial=np.inf)) * (1 - 1e-9)


@contextmanager
def records_per_batch(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows while a table is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best products of every row for which
    ``is_query`` (of a column ``id``) holds with all other rows."""
    spark = prepared(vectors.sparkSession)
    rows = stored(quantised(vectors, id_col, vector_col), "vectors")
    buckets = stored(_blocks(rows, BUCKET), "buckets")
    queries = stored(_blocks(rows.where(is_query), QUERIES), "queries")
    head = buckets.orderBy("block").limit(1).collect()  # one bucket
    seed = spark.sparkContext.broadcast([r.asDict() for r in head])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [Block(r) for r in seed.value]
        for batch in batches:
            for row in batch.to_pylist():
                own = Search(Block(row), k)
                for b in first:
                    own.add(b)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([own.needed()]), pa.array([own.floor.astype("<f8").tobytes()])], ["block", "needed", "floor"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != tile:
                    tile, held = row["tile"], []
                if row["floor"] is None:
                    held.append(Block(row))
                    continue
                own = Search(Block(row), k, np.frombuffer(row["floor"], "<f8"))
                for b in held:
                    own.add(b)
                sizes = [len(ids) for ids, _ in own.top]
                columns = [np.repeat(own.queries.ids, sizes), np.repeat(own.queries.rows, sizes), *(np.concatenate([t[i] for t in own.top]) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_row", "vec_id", "score"])

    with records_per_batch(spark, RECORDS):
        floors = stored(queries.mapInArrow(start, "block long, needed double, floor binary"), "floors")
        # one row a bucket, longest first; tiles that a block needs are the first ones
        placed = buckets.select("block", "longest").withColumn("tile", F.expr(f"(row_number() over (order by block) - 1) div {TILE}"))
        tiles = placed.groupBy("tile").agg(F.max("longest").alias("longest"))
        lengths = stored(tiles.groupBy("longest").agg(F.max("tile").alias("tile")).select("longest", F.max("tile").over(Window.orderBy(F.desc("longest"))).alias("last")), "tiles")
        wanted = floors.select("block", "needed").unionByName(lengths.select(F.lit(None).cast("long").alias("block"), F.col("longest").alias("needed"), "last"), allowMissingColumns=True)
        # the last tile whose longest vector is long enough: the nearest length from above, in order of length
        reach = wanted.withColumn("last", F.max("last").over(Window.orderBy(F.desc("needed"), F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))).where("block is not null and last is not null")
        asked = queries.join(reach.select("block", "last"), "block").join(floors.select("block", "floor"), "block").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        dealt = buckets.join(placed.select("block", "tile"), "block").withColumn("floor", F.lit(None).cast("binary"))
        together = dealt.unionByName(asked.drop("last")).repartition("tile").sortWithinPartitions("tile", F.col("floor").isNotNull(), "block")
        found = stored(together.mapInArrow(search, "query_id long, query_row long, vec_id long, score long"), "found")
    ranked = found.selectExpr("query_id", "row_number() over (partition by query_row order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def oracle(embeddings: str = "embeddings", k: int = 20, scale: int = 64, every: int = 20) -> str:
    return f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as e from {embeddings}
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.r as query_row, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.r <> c.r where q.vec_id % {every} = 0),
r as (select query_id, row_number() over (partition by query_row order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= {k}"""
