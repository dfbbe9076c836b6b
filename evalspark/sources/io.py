"""File sources and sinks (IO-*): result files, organised layouts, logs.

Readers are ``spark.read`` with explicit schemas (no inference), file names
and times from the ``_metadata`` column, and PERMISSIVE parsing with the
rejects kept. Writers are ``DataFrameWriter`` layouts partitioned by the
organising columns; no document is assembled on the driver, and no
document holds an unbounded number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_model_name, parse_timestamp

RESULT_SCHEMA = T.StructType([
    T.StructField("harness", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("execution_time", T.StringType()),
    T.StructField("prompting_strategy", T.StringType()), T.StructField("is_conversational", T.BooleanType()),
])
SUITE_SCHEMA = T.StructType([
    T.StructField("suite_name", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("total_tasks", T.LongType()), T.StructField("results", T.ArrayType(RESULT_SCHEMA)),
])


def _results(raw: DataFrame) -> DataFrame:
    """One row per result of suite documents; a metric that is no number is NULL,
    the others of its map stay."""
    ex = raw.select(F.explode("results").alias("r"), "suite_name", "timestamp", "file_source", "_mtime")
    rows = ex.select("r.*", "file_source", F.coalesce(F.col("suite_name"), F.lit("unknown")).alias("suite_name"),
                     F.coalesce(parse_timestamp("timestamp"), F.col("_mtime")).alias("timestamp"))
    if "metrics" not in rows.columns:
        return rows
    return rows.withColumn("metrics", F.transform_values("metrics", lambda k, v: v.try_cast("double")))


# ----------------------------------------------------------------- IO-1
def read_suite_results(spark: SparkSession, path: str, schema: T.StructType = SUITE_SCHEMA) -> DataFrame:
    """IO-1: suite documents (one JSON document per file, or one per line with
    ``multi_line=False``) -> one row per result with ``file_source``,
    ``suite_name`` (default ``unknown``) and ``timestamp`` (epoch or ISO text;
    default: the file's modification time)."""
    raw = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
           .select("*", F.col("_metadata.file_name").alias("file_source"),
                   F.col("_metadata.file_modification_time").alias("_mtime")))
    return _results(raw)


def read_suite_documents_jsonl(spark: SparkSession, path: str, schema: T.StructType = SUITE_SCHEMA) -> DataFrame:
    """IO-1 for suite documents stored one per line (as ``write_suite_report`` writes them)."""
    raw = (spark.read.schema(schema).json(path)
           .select("*", F.col("_metadata.file_name").alias("file_source"),
                   F.col("_metadata.file_modification_time").alias("_mtime")))
    return _results(raw)


def by_fitness(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected records) of a JSON source: a record that does not fit the schema
    is rejected, also where the fields before the wrong one were read.

    Spark parses only the columns a query uses, and a record is corrupt only by what
    is parsed. The length test, true for any row, uses them all, so that the two sides
    are each other's complement whatever is selected from them."""
    parsed = F.length(F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in schema.fields)))) >= 0
    corrupt = F.col("_corrupt_record")
    return df.filter(corrupt.isNull() & parsed).drop("_corrupt_record"), df.filter(corrupt.isNotNull() & parsed)


# ----------------------------------------------------------------- IO-3
def read_json_dataset(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """IO-3: JSON array / object (``fmt='json'``, whole file) or JSON lines.
    Returns (good rows, rejected raw records). Bad lines are kept aside, not dropped silently."""
    s = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    r = (spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
         .option("multiLine", fmt == "json").json(path))
    r = r.withColumn("_source", F.col("_metadata.file_name"))
    good, bad = by_fitness(r, schema)
    return good, bad.select("_source", "_corrupt_record")


# ----------------------------------------------------------------- IO-4
def flatten_strategy_results(df: DataFrame) -> DataFrame:
    """IO-4: model -> test_cases[] -> results[] to one row per result."""
    tc = df.select("model", F.explode("test_cases").alias("tc"))
    return tc.select("model", F.col("tc.test_name").alias("test_name"), F.col("tc.expected").alias("expected"),
                     F.explode("tc.results").alias("r")).select("model", "test_name", "expected", "r.*")


# ----------------------------------------------------------------- IO-5
def catalog_result_files(files: DataFrame, name: str = "file_name", content: str | None = "content") -> DataFrame:
    """IO-5: classify result files by name prefix (suite_, metrics_,
    generations_); the 10-digit epoch in the name, its date; for metrics
    files model (cleaned) and benchmark from the ``config`` of the content;
    for generation files the benchmark is the last name part."""
    # steps of their own: one projection would work out the parts anew at every use
    files = files.withColumn("__parts", F.regexp_replace(F.col(name), r"\.json$", ""))
    stem, parts = F.col("__parts"), F.split("__parts", "_")
    kind = (F.when(stem.startswith("suite_"), "suite").when(stem.startswith("metrics_"), "metrics")
            .when(stem.startswith("generations_") & (F.size(parts) >= 3), "generations"))
    # a file without a type has no element to explode; a filter on the type would be pushed
    # below the steps, with the whole expression of the name at each use
    out = files.select("*", F.explode(F.array_compact(F.array(kind))).alias("type")).withColumn("__parts", parts)
    kind, parts = F.col("type"), F.col("__parts")
    epoch = F.element_at(F.filter(parts, lambda p: p.rlike("^[0-9]{10}$")), 1)
    out = out.withColumn("timestamp", F.when(kind == "generations", parts[1]).otherwise(F.coalesce(epoch, F.lit("0"))))
    cfg_model = F.get_json_object(F.col(content), "$.config.model") if content else F.lit(None)
    cfg_task = F.get_json_object(F.col(content), "$.config.tasks") if content else F.lit(None)
    return (out.withColumn("date", F.to_date(F.timestamp_seconds(F.col("timestamp").try_cast("long"))))
            .withColumn("model", F.when(F.col("type") == "metrics",
                                        clean_model_name(F.coalesce(cfg_model, F.lit("unknown")))))
            .withColumn("benchmark", F.when(F.col("type") == "metrics", F.coalesce(cfg_task, F.lit("unknown")))
                        .when(F.col("type") == "generations", F.element_at(parts, -1))).drop("__parts"))


# ----------------------------------------------------------------- IO-6
def write_organized(df: DataFrame, root: str, mode: str = "overwrite") -> dict[str, str]:
    """IO-6: three partitioned layouts (by date, by model, by benchmark) for
    non-suite rows, and suites apart. Returns the paths written."""
    paths = {k: f"{root.rstrip('/')}/{k}" for k in ("by_date", "by_model", "by_benchmark", "suites")}
    kept = df.storageLevel != StorageLevel.NONE
    df = df if kept else df.persist()  # four writes, one computation
    try:
        rows = df.filter(F.col("type") != "suite")
        rows.write.mode(mode).partitionBy("date").parquet(paths["by_date"])
        rows.write.mode(mode).partitionBy("model").parquet(paths["by_model"])
        rows.write.mode(mode).partitionBy("benchmark").parquet(paths["by_benchmark"])
        df.filter(F.col("type") == "suite").write.mode(mode).partitionBy("date").parquet(paths["suites"])
    finally:
        if not kept:
            df.unpersist()
    return paths


# ----------------------------------------------------------------- IO-7
def write_suite_report(results: DataFrame, path: str, max_results_per_document: int = 10_000,
                       mode: str = "overwrite", order: Sequence[str] = ("ts", "event_id")) -> str:
    """IO-7: suite documents (suite_name, timestamp, total_tasks, results[])
    written as JSON lines (one document per line), plus a per-(suite, model)
    summary under ``summary/``. A suite is split into documents of at most
    ``max_results_per_document`` results (chunked running counts), so no
    document -- and no task -- holds an unbounded group."""
    from ..operators.aggs import suite_model_summary
    from ..operators.sequence import prefix_sums
    p = prefix_sums(results, ["suite_name"], list(order))
    p = p.withColumn("_doc", ((F.col("seq") - 1) / max_results_per_document).cast("long"))
    cols = [c for c in ("harness", "task", "model", "score", "execution_time", "prompting_strategy",
                        "is_conversational") if c in results.columns]
    docs = p.groupBy("suite_name", "_doc").agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.count(F.lit(1)).alias("total_tasks"),
        F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) if c in ("score", "execution_time") else F.col(c)
                                  for c in cols])).alias("results"))
    out = f"{path.rstrip('/')}/documents"
    docs.drop("_doc").write.mode(mode).json(out)
    suite_model_summary(results, ["suite_name", "model"]).write.mode(mode).json(f"{path.rstrip('/')}/summary")
    return out


# ----------------------------------------------------------------- IO-9
# fixed values: log patterns of the code harness and the language harness
PASS_AT_K = r"pass@(\d+)[\s\"':]+\s*([\d.]+)"
JSON_PIECE = r"\{[^}]*\"pass@\d+\"[^}]*\}"
NUMBER = r"(\d+\.?\d*)"


def parse_harness_logs(logs: DataFrame, kind: str = "code", run: str = "run_id", line_no: str = "line_no",
                       line: str = "line") -> DataFrame:
    """IO-9: metrics from harness output lines -> (run, metric, value).

    code: every ``pass@k`` value by pattern, the last one per k; values in
    JSON pieces (per line) win over pattern values; ``extracted_score`` =
    last number of the last line mentioning accuracy / score / eval; runs
    with nothing get pass@1 = 0. language: the ``results`` of the first line
    that is a JSON object with "results" (flattened task.metric); else the
    last number of the first line mentioning accuracy / score; a run with neither
    has one row without metric and value. Text among the values of a JSON piece or
    of a result (an alias) is passed over, the numbers beside it stay.
    """
    low = F.lower(F.col(line))
    if kind == "code":
        pat = logs.filter(low.contains("pass@")).select(
            run, line_no, F.posexplode(F.arrays_zip(F.regexp_extract_all(low, F.lit(PASS_AT_K), 1).alias("k"),
                                                    F.regexp_extract_all(low, F.lit(PASS_AT_K), 2).alias("v")))
            .alias("pos", "m"))
        pat = pat.select(run, line_no, "pos", F.concat(F.lit("pass@"), F.col("m.k")).alias("metric"),
                         F.col("m.v").try_cast("double").alias("value"), F.lit(0).alias("src"))
        js = logs.select(run, line_no, F.posexplode(F.regexp_extract_all(F.col(line), F.lit(JSON_PIECE), 0))
                         .alias("pos", "j"))
        js = js.select(run, line_no, "pos", F.explode(F.from_json("j", "map<string,string>")).alias("metric", "value"))
        js = js.withColumn("value", F.col("value").try_cast("double"))
        js = js.filter(F.col("metric").startswith("pass@") & F.col("value").isNotNull()).withColumn("src", F.lit(1))
        both = pat.filter(F.col("value").isNotNull()).unionByName(js)
        passk = both.groupBy(run, "metric").agg(F.max_by("value", F.struct("src", line_no, "pos")).alias("value"))
        score_lines = logs.filter(low.contains("accuracy") | low.contains("score") | low.contains("eval")) \
            .withColumn("_n", F.element_at(F.regexp_extract_all(F.col(line), F.lit(NUMBER), 1), -1)) \
            .filter(F.col("_n").isNotNull())
        extracted = score_lines.groupBy(run).agg(F.max_by(F.col("_n").try_cast("double"), F.col(line_no)).alias("value")) \
            .select(run, F.lit("extracted_score").alias("metric"), "value")
        found = passk.select(run, "metric", "value").unionByName(extracted)
        runs = logs.select(run).distinct()
        empty = runs.join(found.select(run).distinct(), run, "left_anti") \
            .select(run, F.lit("pass@1").alias("metric"), F.lit(0.0).alias("value"))
        return found.unionByName(empty)
    first_json = (logs.filter(F.trim(F.col(line)).startswith("{") & F.col(line).contains('"results"'))
                  .withColumn("_r", F.from_json(F.trim(F.col(line)), "struct<results: map<string, map<string, string>>>"))
                  .filter(F.col("_r.results").isNotNull())
                  .groupBy(run).agg(F.min_by("_r.results", F.col(line_no)).alias("results")))
    js = first_json.select(run, F.explode("results").alias("task", "m")).select(
        run, F.explode("m").alias("name", "value"), "task").select(
        run, F.concat_ws(".", "task", "name").alias("metric"), F.col("value").try_cast("double").alias("value")).filter(F.col("value").isNotNull())
    fallback = (logs.join(first_json.select(run), run, "left_anti")
                .filter(low.contains("accuracy") | low.contains("score"))
                .withColumn("_n", F.element_at(F.regexp_extract_all(F.col(line), F.lit(NUMBER), 1), -1))
                .filter(F.col("_n").isNotNull())
                .groupBy(run).agg(F.min_by(F.col("_n").try_cast("double"), F.col(line_no)).alias("value"))
                .select(run, F.lit("extracted_score").alias("metric"), "value"))
    found = js.unionByName(fallback)
    none = logs.select(run).distinct().join(found.select(run).distinct(), run, "left_anti")
    return found.unionByName(none.select(run, F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")))


# ----------------------------------------------------------------- IO-10
def latest_file_per_key(files: DataFrame, keys: Sequence[str], mtime: str = "mtime") -> DataFrame:
    """IO-10: the newest file per key (``max_by`` in a hash aggregate)."""
    others = [c for c in files.columns if c not in keys]
    best = files.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(mtime, *others)).alias("_f"))
    return best.select(*keys, "_f.*")
