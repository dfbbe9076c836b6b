"""Ordered-sequence primitives: row numbers, running sums, rolling windows and
carried values per key, skew-proof.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key in
one task; with one model holding a third of the history that task sorts a
third of the data, and without a key it sorts the whole table. Here a key with more
than ``rows_per_chunk`` rows is cut into *chunks*: ranges of its whole order tuple, so
ties in the first column are split by the next. There are as many chunks as the key's
rows need. The bounds are quantiles of a sample of ``SAMPLES`` tuples a chunk, those
with the smallest hash: the same in every branch of a plan and in every
retry after a lost executor. A row finds its chunk by a search tree over the bounds.

Rows then move once, by (key, chunk); windows run inside a chunk, and what a chunk needs
from its neighbours (offsets, the last rows before it, the next event after it) comes
from one row per chunk, joined on the same (key, chunk). Nothing is checkpointed, no row
is joined with another row of its key, the plan is the same at every size, and no job
runs while it is made. A task holds the rows of a chunk: about ``rows_per_chunk``,
over twice that only where the sample misjudges a quantile by five of its standard deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .keys import join_keys

ROWS_PER_CHUNK = 2_000_000
SAMPLES = 32  # sampled tuples a chunk, at least
FAN = 64      # bounds compared at each level of the search


def _search(levels: Sequence[str], tuple_: Column) -> Column:
    """How many of the bounds in the last of ``levels`` are <= ``tuple_``; every
    level holds each ``FAN``-th bound of the next."""
    at = F.size(F.filter(levels[0], lambda p: p <= tuple_))
    for level in levels[1:]:
        block = F.slice(level, at * FAN + 1, F.lit(FAN))
        at = at * FAN + F.size(F.filter(block, lambda p: p <= tuple_))
    return at


def _bounds(df: DataFrame, keys: list[str], tuple_: Column, rows_per_chunk: int, least: int) -> DataFrame:
    """Per key of more than ``rows_per_chunk`` rows the bounds of its chunks, in levels
    ``_l0`` .. ``_l2``."""
    per_chunk = max(SAMPLES, 2 * least)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_chunk)
    large = large.withColumn("_c", F.ceil(F.col("_n") / F.lit(float(rows_per_chunk))))
    rows = join_keys(df.select(*keys, tuple_.alias("_o")), large, keys)
    share = F.shiftrightunsigned(F.xxhash64("_o"), 11) / F.lit(float(1 << 53))
    sample = rows.where(share < F.col("_c") * F.lit(float(per_chunk)) / F.col("_n")).distinct()
    sampled = sample.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list("_o")).alias("_s"))
    # distinct tuples are distinct rows: a chunk with ``least`` of them has as many rows
    c = F.least(F.col("_c"), F.floor(F.size("_s") / F.lit(float(least))))
    points = sampled.withColumn("_c", F.greatest(c, F.lit(1)).cast("int")).where("_c > 1").select(*keys, F.expr(
        "transform(sequence(1, _c - 1), i -> _s[cast(cast(i as bigint) * size(_s) div _c as int)])").alias("_l2"))
    every = f"case when size({{0}}) >= {FAN} then transform(sequence({FAN}, size({{0}}), {FAN}), i -> {{0}}[i - 1]) else slice({{0}}, 1, 0) end"
    return points.withColumn("_l1", F.expr(every.format("_l2"))).withColumn("_l0", F.expr(every.format("_l1")))


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                rows_per_chunk: int = ROWS_PER_CHUNK, least: int = 1) -> DataFrame:
    """Add ``_chunk``, 0 .. c-1 in the order of the tuple ``order``: c is about the
    key's rows / ``rows_per_chunk``, 1 for a key that has no more than that. A chunk of
    a key with several has ``least`` rows or more."""
    keys, order = list(keys), list(order)
    tuple_ = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    bounds = _bounds(df, keys, tuple_, rows_per_chunk, least)
    levels = ["_l0", "_l1", "_l2"]
    # without a key the one row, or none, becomes one row
    j = join_keys(df, bounds, keys, "left") if keys else df.crossJoin(F.broadcast(bounds.agg(*(F.first(x).alias(x) for x in levels))))
    chunk = F.when(F.col("_l2").isNull(), F.lit(0)).otherwise(_search(levels, tuple_))
    return j.withColumn("_chunk", chunk.cast("long")).drop(*levels)


@dataclass(frozen=True)
class Chunks:
    """Rows with their chunk. ``part`` names a chunk: ``_key`` (the keys as a struct,
    which is never NULL itself) and ``_chunk``."""

    rows: DataFrame
    part: tuple[str, ...]
    order: tuple[str, ...]

    def window(self, first: int = Window.unboundedPreceding, last: int = 0) -> WindowSpec:
        """Rows ``first`` to ``last`` around each, inside its chunk."""
        return Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(first, last)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    @property
    def chunks(self) -> WindowSpec:
        """Over the one row of each chunk, in order."""
        return Window.partitionBy(*self.part[:-1]).orderBy("_chunk")

    @property
    def chunks_before(self) -> WindowSpec:
        return self.chunks.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def chunks_after(self) -> WindowSpec:
        return self.chunks.rowsBetween(1, Window.unboundedFollowing)

    def joined(self, local: DataFrame, per_chunk: DataFrame) -> DataFrame:
        """``local`` rows with the columns of their chunk."""
        return local.join(per_chunk, list(self.part))

    def plain(self, local: DataFrame) -> DataFrame:
        return local.drop(*self.part)

    def totals(self, *aggregates: Column, of: DataFrame | None = None) -> DataFrame:
        """One row per chunk."""
        return (self.rows if of is None else of).groupBy(*self.part).agg(*aggregates)

    def tails(self, n: int, value: Column) -> DataFrame:
        """Per chunk ``_tail``: ``value`` of the last ``n`` rows before the chunk, in
        order (NULL for a key's first chunk). Tasks pass on at most ``n`` rows a chunk."""
        back = Window.partitionBy(*self.part).orderBy(*(F.desc(c) for c in self.order))
        last = self.rows.select(*self.part, value.alias("v"), F.row_number().over(back).alias("r")).where(F.col("r") <= n)
        own = last.groupBy(*self.part).agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "v"))).alias("_t"))
        return own.select(*self.part, F.transform(F.lag("_t").over(self.chunks), lambda t: t["v"]).alias("_tail"))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK, least: int = 1) -> Chunks:
    rows = with_chunks(df, keys, order, rows_per_chunk, least)
    if not keys:
        return Chunks(rows, ("_chunk",), tuple(order))
    return Chunks(rows.withColumn("_key", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))), ("_key", "_chunk"), tuple(order))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                cols: dict[str, Column] | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``seq`` (1-based position within the key by ``order``) and, for
    every ``name -> expr`` in ``cols``, ``cum_<name>`` = inclusive running sum.

    ``order`` must be unique within a key (e.g. (ts, event_id)).
    """
    cols = dict(cols or {})
    base = df
    for name, expr in cols.items():
        base = base.withColumn(f"_v_{name}", expr)
    ch = chunked(base, keys, order, rows_per_chunk)
    local = ch.rows.withColumn("_lc", F.count(F.lit(1)).over(ch.window()))
    for name in cols:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(ch.window()))
    totals = ch.totals(F.count(F.lit(1)).alias("_tc"), *(F.sum(f"_v_{name}").alias(f"_t_{name}") for name in cols))
    before = totals.select(*ch.part, F.coalesce(F.sum("_tc").over(ch.chunks_before), F.lit(0)).alias("_oc"),
                           *(F.sum(f"_t_{name}").over(ch.chunks_before).alias(f"_o_{name}") for name in cols))
    out = ch.joined(local, before).withColumn("seq", (F.col("_oc") + F.col("_lc")).cast("long"))
    for name in cols:
        zero = F.lit(0).cast(out.schema[f"_l_{name}"].dataType)
        out = out.withColumn(f"cum_{name}", F.coalesce(F.col(f"_o_{name}"), zero) + F.col(f"_l_{name}"))
    return ch.plain(out).drop("_lc", "_oc", *(f"_{p}_{name}" for name in cols for p in ("v", "l", "o")))


def sequence_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``seq``: 1-based position of each row within its key."""
    return prefix_sums(df, keys, order, None, rows_per_chunk)


def rolled(ch: Chunks, value: str, counted: dict[str, Callable[[Column], Column]], rows: int, current: bool) -> DataFrame:
    """The rows of ``ch`` (chunks of ``rows`` rows or more) with ``seq`` and, for every
    ``name -> condition`` in ``counted``, the number of the last ``rows`` rows (with
    the current one or before it) whose ``value`` meets it.

    Inside a chunk a bounded frame counts; the first rows of a chunk count the rest among
    the last rows before it, a bounded array on the chunk's row."""
    first, last = (1 - rows, 0) if current else (-rows, -1)
    local = ch.rows.withColumn("_lc", F.row_number().over(ch.ordered))
    for name, holds in counted.items():
        local = local.withColumn(f"_l_{name}", F.count_if(holds(F.col(value))).over(ch.window(first, last)))
    before = ch.totals(F.count(F.lit(1)).alias("_tc")).select(*ch.part, F.coalesce(F.sum("_tc").over(ch.chunks_before), F.lit(0)).alias("_oc"))
    out = ch.joined(ch.joined(local, before), ch.tails(rows, F.col(value)))
    missing = (F.lit(rows) - F.col("_lc") + (0 if current else 1)).cast("int")
    held = F.least(missing, F.size("_tail"))
    borrowed = F.when((missing > 0) & F.col("_tail").isNotNull(), F.slice("_tail", F.size("_tail") - held + 1, held))
    out = out.withColumn("_b", borrowed).withColumn("seq", (F.col("_oc") + F.col("_lc")).cast("long"))
    for name, holds in counted.items():
        out = out.withColumn(name, F.col(f"_l_{name}") + F.when(F.col("_b").isNull(), F.lit(0)).otherwise(F.size(F.filter("_b", holds))))
    return out.drop("_lc", "_oc", "_tail", "_b", *(f"_l_{name}" for name in counted))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several branches of a plan read
    (scores of a Python solve): ``checkpoint()`` into the shared folder
    named by ``spark.checkpoint.dir`` -- computed once, survives executor
    loss, and keeps the downstream plan from re-deriving it per branch."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
