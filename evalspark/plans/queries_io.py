"""Catalog entries: file sources and sinks (round trips through files that
Spark writes from the driver's tables into the shared checkpoint folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggs, ranking
from ..session import checkpoint_dir
from ..sources import io
from .catalog import query


def _scratch(v, name: str) -> str:
    return f"{checkpoint_dir(v.spark).rstrip('/')}/evalspark-io/{name}-{uuid.uuid4().hex}"


@query("io1_suite_report_round_trip")
def _io1(v):
    """IO-7 writes suite documents (bounded size) from the results; IO-1 reads them back; IO-2 cleans."""
    res = aggs.preprocess_results(v.eval_results)
    path = io.write_suite_report(res, _scratch(v, "suites"), max_results_per_document=500)
    back = io.read_suite_documents_jsonl(v.spark, path)
    return aggs.preprocess_results(back).select("model", "task", "suite_name", "score", "execution_time",
                                                "prompting_strategy", "is_conversational", "success", "language")


@query("io3_read_json_dataset")
def _io3(v):
    base = _scratch(v, "jsonl")
    v.table("events").select("event_id", "value", "props").write.mode("overwrite").json(f"{base}/good")
    v.table("benchmark").select("text").write.mode("overwrite").text(f"{base}/bad")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("props", T.StringType())])
    good, bad = io.read_json_dataset(v.spark, f"{base}/*", schema)
    return good.select("event_id", "value", "props")


@query("io3_rejected_records")
def _io3b(v):
    base = _scratch(v, "jsonl")
    v.table("events").select("event_id", "value", "props").write.mode("overwrite").json(f"{base}/good")
    v.table("benchmark").select("text").write.mode("overwrite").text(f"{base}/bad")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("props", T.StringType())])
    good, bad = io.read_json_dataset(v.spark, f"{base}/*", schema)
    return bad.select(F.col("_corrupt_record").alias("record"))


def _files(v):
    r = v.eval_results
    prefix = (F.when(F.col("harness") == "failed", "suite_").when(F.col("harness") == "bigcode", "metrics_")
              .otherwise("generations_"))
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    name = F.when(prefix == "generations_", F.concat(prefix, epoch, F.lit("_"), F.col("task"), F.lit(".json"))) \
        .otherwise(F.concat(prefix, F.col("model"), F.lit("_"), epoch, F.lit(".json")))
    content = F.to_json(F.struct(F.struct(F.concat(F.lit("org/"), F.col("model"), F.lit(" v1")).alias("model"),
                                          F.col("task").alias("tasks")).alias("config")))
    return r.select("event_id", name.alias("file_name"), content.alias("content"), "ts", "model", "task")


@query("io5_catalog_result_files")
def _io5(v):
    f = _files(v).select("event_id", "file_name", "content")
    return io.catalog_result_files(f).select("event_id", "type", "timestamp", "date", "model", "benchmark")


@query("io10_latest_file_per_key")
def _io10(v):
    f = _files(v).select("model", "task", F.col("ts").alias("mtime"), "event_id", "file_name")
    return io.latest_file_per_key(f, ["model", "task"], "mtime")


def _logs(v):
    r = v.eval_results
    line = (F.when(F.col("task") == "humaneval", F.concat(F.lit("pass@1: "), F.col("score").cast("string")))
            .when(F.col("task") == "mbpp", F.concat(F.lit('{"pass@10": '), F.col("score").cast("string"), F.lit("}")))
            .when(F.col("task") == "multiple-js", F.concat(F.lit("eval accuracy "), F.col("execution_time").cast("string")))
            .otherwise(F.concat(F.lit("progress "), F.col("event_id").cast("string"))))
    return r.select(F.concat(F.col("model"), F.lit("/"), F.col("suite_name")).alias("run_id"),
                    F.col("event_id").alias("line_no"), line.alias("line"))


@query("io9_parse_harness_logs")
def _io9(v):
    return io.parse_harness_logs(_logs(v), "code")


@query("io9_parse_language_harness_logs")
def _io9l(v):
    """Runs of the language harness: a JSON results line with an alias beside the numbers, score lines, or neither."""
    r = v.eval_results
    result = F.concat(F.lit('{"results": {"'), F.col("task"), F.lit('": {"acc": '), F.col("score").cast("string"), F.lit(', "alias": "'), F.col("task"), F.lit('"}}}'))
    line = (F.when((F.col("task") == "mbpp") & (F.col("model") != "model_1"), result)
            .when((F.col("task") == "multiple-js") & (F.col("model") != "model_2"), F.concat(F.lit("accuracy "), F.col("execution_time").cast("string")))
            .otherwise(F.concat(F.lit("progress "), F.col("event_id").cast("string"))))
    logs = r.select(F.concat(F.col("model"), F.lit("/"), F.col("suite_name")).alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    return io.parse_harness_logs(logs, "language")


@query("io12_latest_n")
def _io12(v):
    return ranking.latest_n(v.feedback, 100).select("event_id", "model", "strategy", "quality_score", "ts")


@query("io4_flatten_strategy_results")
def _io4(v):
    """Nested research-result rows (model -> test_cases[] -> results[]) built per feedback row, flattened back."""
    fb = v.feedback
    case = F.struct(F.concat(F.lit("case_"), F.col("event_id").cast("string")).alias("test_name"),
                    F.lit("x").alias("expected"),
                    F.array(F.struct("strategy", "success", "quality_score")).alias("results"))
    nested = fb.select("model", F.array(case).alias("test_cases"))
    return io.flatten_strategy_results(nested)


@query("io6_write_organized_round_trip")
def _io6(v):
    """IO-5 catalog written in the three layouts (IO-6); the by-benchmark layout read back."""
    cat = io.catalog_result_files(_files(v).select("event_id", "file_name", "content"))
    paths = io.write_organized(cat.select("event_id", "type", "timestamp", "date", "model", "benchmark"),
                               _scratch(v, "organized"))
    return v.spark.read.parquet(paths["by_benchmark"]).select("event_id", "type", "timestamp", "benchmark")
