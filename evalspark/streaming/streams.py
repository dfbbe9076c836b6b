"""Structured Streaming versions of the incremental operators (SS-*).

Event time is ``ts`` (cast from TIMESTAMP_NTZ to TIMESTAMP: ``withWatermark``
refuses NTZ), the watermark defaults to 10 minutes, and late rows are
dropped by Spark's watermark rule. Sinks are the caller's; ``run_to_table``
runs a query to completion (``Trigger.AvailableNow``) for batch-style use and
tests, with its checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.bandit import arm_statistics
from ..operators.learning import TRANSITIONS
from ..session import checkpoint_dir
from ..sources.io import by_fitness

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ----------------------------------------------------------------- SS-1
def stream_results(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                   max_files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """SS-1: file stream of result rows with a fixed schema; rejected records
    are a second stream (JSON only)."""
    r = spark.readStream.schema(schema if fmt != "json" else T.StructType(
        list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())]))
    r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        df = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        good, bad = by_fitness(df, schema)
        return good, bad.select("_corrupt_record")
    return r.format(fmt).load(path), None


# ----------------------------------------------------------------- SS-2
def stream_arm_statistics(feedback: DataFrame, d: int) -> DataFrame:
    """SS-2: BD-1 kept up to date -- the sums are additive, so this is plain
    stateful aggregation (update or complete mode)."""
    return arm_statistics(feedback, d)


# ----------------------------------------------------------------- SS-3
def stream_resource_windows(samples: DataFrame, watermark: str = WATERMARK, tumbling: str = "5 minutes",
                            sliding: tuple[str, str] = ("10 minutes", "5 minutes")) -> tuple[DataFrame, DataFrame]:
    """SS-3: per host, tumbling 5-minute and sliding 10/5-minute windows of
    mean / max cpu, mean memory and the sample count."""
    s = event_time(samples).withWatermark("ts", watermark)
    aggs = [F.avg("cpu_percent").alias("mean_cpu"), F.max("cpu_percent").alias("max_cpu"),
            F.avg("memory_percent").alias("mean_memory"), F.count(F.lit(1)).alias("samples")]
    tum = s.groupBy(F.window("ts", tumbling).alias("w"), "host").agg(*aggs)
    sli = s.groupBy(F.window("ts", *sliding).alias("w"), "host").agg(*aggs)
    flat = lambda d: d.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                              *[c for c in d.columns if c != "w"])
    return flat(tum), flat(sli)


# ----------------------------------------------------------------- SS-4
def stream_sessions(feedback: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK,
                    user: str = "session_user") -> DataFrame:
    """SS-4: LR-1's counts and mean quality per user session (gap 30 minutes)."""
    s = event_time(feedback).withWatermark("ts", watermark)
    g = s.groupBy(F.session_window("ts", gap).alias("s"), user).agg(
        F.count(F.lit(1)).alias("interactions"), F.count_if(F.col("success")).alias("successes"),
        F.avg("quality_score").alias("average_quality"))
    return g.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "interactions", "successes", "average_quality")


# ----------------------------------------------------------------- SS-5
MERGE = 8      # runs that are merged into one of the next tier
FILES = 32     # files of a run, dealt by the key


def _newest(rows: DataFrame, key: str, ts: str, tie: str | None) -> DataFrame:
    """Newest row per key (IO-11 semantics); among equal times and ties the later batch."""
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []), F.col("_batch"))
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The (first, last) batches of the complete runs below ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(tuple(int(x) for x in n.removeprefix("run=").split("-")) for n in whole)


def current_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The runs that make up the table: from the first batch on, always the longest one.
    At most ``MERGE - 1`` of every tier, that is (MERGE - 1) * log(batches) / log(MERGE)."""
    out, at = [], None
    for first, last in sorted(_runs(spark, path), key=lambda r: (r[0], -r[1])):
        if at is None or first > at:
            out.append((first, last))
            at = last
    return out


def _read_runs(spark: SparkSession, path: str, runs: list[tuple[int, int]], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*(f"{path}/run={a}-{b}" for a, b in runs))


def _write_run(rows: DataFrame, key: str, path: str, first: int, last: int) -> None:
    rows.repartition(FILES, key).write.mode("overwrite").parquet(f"{path}/run={first}-{last}")


def _drop_runs(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> None:
    jvm = spark.sparkContext._jvm
    for a, b in runs:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/run={a}-{b}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stream_upsert(stream: DataFrame, key: str, path: str, ts: str = "ts", tie: str | None = None,
                  checkpoint: str | None = None, trigger_available_now: bool = True):
    """SS-5: newest row per key. There is no watermark: a row counts however
    late it comes, and an exact duplicate changes nothing. Every micro-batch is
    reduced to its newest row per key and written as the run ``<path>/run=<n>-<n>``
    of at most ``FILES`` files. Whenever ``MERGE`` runs of a tier are complete they are
    merged into one of the next, so a row is rewritten once a tier and a read sees a
    bounded number of files however many batches there were. A run is complete with its
    ``_SUCCESS`` file and never changes but by a retry of its own batch, which writes the
    same rows -- exactly once; merged runs stay until the tier above is merged, for
    readers that have listed them. ``current_upsert_table`` gives the merged table.
    Returns the started query."""
    s = event_time(stream, ts)
    path = path.rstrip("/")

    def per_batch(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        newest = _newest(batch.withColumn("_batch", F.lit(n).cast("long")), key, ts, tie)
        _write_run(newest, key, path, n, n)
        size = 1
        while (n + 1) % (size * MERGE) == 0:
            parts = [(k, k + size - 1) for k in range(n + 1 - size * MERGE, n + 1, size)]
            _write_run(_newest(_read_runs(spark, path, parts, newest.schema), key, ts, tie), key, path, n + 1 - size * MERGE, n)
            size *= MERGE
        # what a tier before the last merged one still holds of these batches is read by nobody now
        whole = _runs(spark, path)
        _drop_runs(spark, path, [r for r in whole if any(a <= r[0] and r[1] <= b and (b - a + 1) > MERGE * (r[1] - r[0] + 1) for a, b in whole)])

    ck = checkpoint or f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/evalspark-stream/{uuid.uuid4().hex}"
    w = s.writeStream.foreachBatch(per_batch).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


def current_upsert_table(spark: SparkSession, path: str, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The SS-5 table: newest row per key over its current runs."""
    path = path.rstrip("/")
    return _newest(_read_runs(spark, path, current_runs(spark, path)), key, ts, tie).drop("_batch")


# ----------------------------------------------------------------- SS-6
PHASE_OUT = T.StructType([T.StructField("model", T.StringType()), T.StructField("seq", T.LongType()),
                          T.StructField("ts", T.TimestampType()), T.StructField("from_phase", T.StringType()),
                          T.StructField("to_phase", T.StringType())])
PHASE_ROWS = 50          # success flags that a rate looks back on
HOLD_MICROS = 60_000_000  # rows wait in slots of this length


def phase_transitions(phase: str, count: int, flags: np.ndarray, new: np.ndarray) -> tuple[str, list[tuple[int, str, str]]]:
    """Run the phase machine over ``new`` success flags, in order, after ``count`` rows
    of which ``flags`` are the last ones: (phase after them, [(index in new, from, to)])."""
    rules = {frm: (to, n, s) for frm, to, n, s in TRANSITIONS}
    sums = np.concatenate([[0], np.cumsum(np.concatenate([flags, new]))])
    ends = np.arange(len(flags) + 1, len(sums))
    starts = np.maximum(ends - PHASE_ROWS, 0)
    rates, seq = (sums[ends] - sums[starts]) / (ends - starts), count + 1 + np.arange(len(new))
    at, out = 0, []
    while phase in rules:
        to, n_min, s_min = rules[phase]
        holds = np.flatnonzero((seq[at:] >= n_min) & (rates[at:] >= s_min))
        if not len(holds):
            break
        at += int(holds[0])
        out.append((at, phase, to))
        phase, at = to, at + 1
    return phase, out


class PhaseProcessor(StatefulProcessor):
    """Holds a model's rows in slots of ``HOLD_MICROS`` until the watermark has passed a
    slot's end -- an event-time timer tells -- and then runs the phase machine over them by
    (ts, event_id). No row can come late for a slot that has been run, so the result does
    not depend on the borders of micro-batches. The state is the phase, a count, the last
    ``PHASE_ROWS`` flags and the open slots; a model in its last phase holds nothing."""

    def init(self, handle) -> None:
        self.handle = handle
        self.phase = handle.getValueState("phase", "phase string, count long, flags array<boolean>")
        self.slots = handle.getMapState("slots", "slot long", "times array<long>, ids array<long>, flags array<boolean>")

    def _now(self) -> tuple[str, int, np.ndarray]:
        phase, count, flags = self.phase.get() if self.phase.exists() else ("exploration", 0, [])
        return phase, count, np.array(flags, bool)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._now()[0] == TRANSITIONS[-1][1]:
            return
        for frame in rows:
            frame = frame[frame["event_id"].notna()]  # a heartbeat only moves the watermark
            times = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            for slot, own in frame.assign(t=times, slot=times // HOLD_MICROS).groupby("slot"):
                if self.slots.containsKey((int(slot),)):
                    had = self.slots.getValue((int(slot),))
                else:
                    had = ([], [], [])
                    self.handle.registerTimer((int(slot) + 1) * HOLD_MICROS // 1000)
                added = (own["t"].tolist(), own["event_id"].astype("int64").tolist(), own["success"].fillna(False).astype(bool).tolist())
                self.slots.updateValue((int(slot),), tuple([*h, *a] for h, a in zip(had, added)))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // HOLD_MICROS  # slots below it are complete
        phase, count, flags = self._now()
        out = []
        for slot in sorted(s for (s,) in self.slots.keys() if s < closed):
            times, ids, new = (np.array(c) for c in self.slots.getValue((slot,)))
            order = np.lexsort((ids, times))
            phase, found = phase_transitions(phase, count, flags, new[order])
            out += [(key[0], count + i + 1, pd.Timestamp(int(times[order[i]]), unit="us"), frm, to) for i, frm, to in found]
            count, flags = count + len(new), np.concatenate([flags, new[order]])[-PHASE_ROWS:]
            self.slots.removeKey((slot,))
        self.phase.update((phase, int(count), flags.tolist()))
        if phase == TRANSITIONS[-1][1]:
            self.slots.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in PHASE_OUT.fields])


def stream_phase(feedback: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """SS-6: LR-4's forward-only phase machine as it happens, one row per transition, in
    event time (:class:`PhaseProcessor`, on the RocksDB state store that
    ``transformWithState`` needs). A transition is given once the watermark has passed it.
    Rows without an ``event_id`` are heartbeats; ``with_heartbeat`` closes a finite input."""
    feedback.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = event_time(feedback).withWatermark("ts", watermark).select("model", "ts", "event_id", "success")
    return s.groupBy("model").transformWithStateInPandas(PhaseProcessor(), PHASE_OUT, "Append", "EventTime")


def with_heartbeat(df: DataFrame, after: str = "1 day", ts: str = "ts") -> DataFrame:
    """``df`` and one more row, ``after`` its last one and NULL but for the time: it moves
    the watermark past all others."""
    last = df.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    return df.unionByName(last.select(*((F.col(ts) if c == ts else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns)))


# ----------------------------------------------------------------- helpers
def stage_in_time_slices(df: DataFrame, path: str, slices: int = 4, ts: str = "ts") -> str:
    """Write ``df`` as ``slices`` consecutive time slices (one write each, so
    file times follow event time) -- the staged input for AvailableNow runs."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    lo, hi = bounds.lo, bounds.hi
    width = max(1, (hi - lo + 1) // slices + 1)
    for i in range(slices):
        part = df.filter((t >= lo + i * width) & (t < lo + (i + 1) * width))
        part.write.mode("append").parquet(path)
    return path


def run_to_table(stream_df: DataFrame, mode: str = "complete", name: str | None = None) -> DataFrame:
    """Run a streaming query to completion (AvailableNow) into parquet in the
    shared checkpoint folder and return the final result as a batch
    DataFrame. Every micro-batch writes a directory of its own, so a retried batch
    replaces itself and a reader never meets half a table. ``complete``: the newest
    one is the full result; ``append``: all of them are."""
    spark = stream_df.sparkSession
    name = name or f"evalspark_{uuid.uuid4().hex[:12]}"
    base = f"{checkpoint_dir(spark).rstrip('/')}/evalspark-stream/{name}"
    out = f"{base}/table"

    done: list[int] = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        done.append(batch_id)

    q = (stream_df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream_df.schema)
    batches = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream_df.schema).parquet(*(f"{out}/batch_id={n}" for n in batches))
