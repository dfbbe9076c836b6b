"""Catalog entries: streaming operators, run to completion over the driver's
tables staged as time-ordered file slices (Trigger.AvailableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bandit as BD
from ..operators import ops
from ..session import checkpoint_dir

from ..streaming import streams as SS
from .catalog import query
from .queries_bandit import CONTEXT


def _stage(v, df, name: str, fmt: str = "parquet", slices: int = 4) -> str:
    path = f"{checkpoint_dir(v.spark).rstrip('/')}/evalspark-stage/{name}-{uuid.uuid4().hex}"
    if fmt == "parquet":
        return SS.stage_in_time_slices(df, path, slices)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    b = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    width = max(1, (b.hi - b.lo + 1) // slices + 1)
    for i in range(slices):
        df.filter((t >= b.lo + i * width) & (t < b.lo + (i + 1) * width)).write.mode("append").json(path)
    return path


def _read_stream(v, df, path: str, files_per_trigger: int = 1):
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


@query("ss1_stream_results")
def _ss1(v):
    res = v.eval_results.select("event_id", "model", "task", "score", "ts")
    path = _stage(v, res, "results-json", "json")
    schema = res.schema
    good, _ = SS.stream_results(v.spark, path, schema, "json", max_files_per_trigger=1)
    return SS.run_to_table(good, "append").select("event_id", "model", "task", "score")


@query("ss2_stream_arm_statistics")
def _ss2(v):
    fb = v.feedback
    d = CONTEXT
    s = _read_stream(v, fb, _stage(v, fb, "feedback"))
    t = SS.run_to_table(SS.stream_arm_statistics(s, d), "complete")
    pairs = BD._pairs(d)
    return t.select("model", "strategy", *[F.col("a_packed")[k].alias(f"a_{i}_{j}") for k, (i, j) in enumerate(pairs)],
                    *[F.col("b")[i].alias(f"b_{i}") for i in range(d)], "count", "reward_sum", "mean_reward",
                    "successes")


@query("ss3_stream_resource_windows_tumbling")
def _ss3(v):
    rs = v.resource_samples
    s = _read_stream(v, rs, _stage(v, rs, "resources"))
    tum, _ = SS.stream_resource_windows(s)
    return SS.run_to_table(tum, "complete")


@query("ss3_stream_resource_windows_sliding")
def _ss3s(v):
    rs = v.resource_samples
    s = _read_stream(v, rs, _stage(v, rs, "resources"))
    _, sli = SS.stream_resource_windows(s)
    return SS.run_to_table(sli, "complete")


@query("ss4_stream_sessions")
def _ss4(v):
    fb = v.feedback.select("event_id", "session_user", "success", "quality_score", "ts")
    s = _read_stream(v, fb, _stage(v, fb, "sessions"))
    return SS.run_to_table(SS.stream_sessions(s), "complete")  # open sessions too


@query("ss5_stream_upsert")
def _ss5(v):
    c = ops.cache_key(v.cache_entries).select("cache_key", "entry_id", "ts", "score", "access_count")
    s = _read_stream(v, c, _stage(v, c, "cache"))
    out = f"{checkpoint_dir(v.spark).rstrip('/')}/evalspark-upsert/{uuid.uuid4().hex}"
    SS.stream_upsert(s, "cache_key", out, tie="entry_id").awaitTermination()
    return SS.current_upsert_table(v.spark, out, "cache_key", tie="entry_id")


@query("ss6_stream_phase")
def _ss6(v):
    fb = v.feedback.select("event_id", "model", "success", "ts")
    s = _read_stream(v, fb, _stage(v, SS.with_heartbeat(fb), "phase"))
    return SS.run_to_table(SS.stream_phase(s), "append")


