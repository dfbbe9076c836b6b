"""The input views: the driver's tables re-shaped to the operators' inputs.

Each view is a narrow projection over one parquet table, so Catalyst prunes
the scan to the columns a query needs and pushes filters into the reader;
no view shuffles. The shapes are those of the evaluation data the operators
were written for (results, per-attempt samples, feedback, generations, ...).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _k(props: str = "props") -> Column:
    return F.regexp_extract(F.col(props), '"k": ([0-9]+)', 1).try_cast("double")


def _case(col: Column, pairs, default=None) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END``."""
    out = None
    for k, v in pairs:
        out = (F.when(col == k, v) if out is None else out.when(col == k, v))
    return out.otherwise(default) if default is not None else out


class Views:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..session import ship_package
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        ship_package(spark)
        # Every date/time expression below is evaluated in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------
    @cached_property
    def eval_results(self) -> DataFrame:
        """One row per evaluation result (model, task, suite, harness, score, ...)."""
        e = self.table("events")
        et = F.col("event_type")
        eid = F.col("event_id")
        return e.select(
            "event_id",
            F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"),
            _case(et, [("click", "humaneval"), ("view", "multiple-js"), ("purchase", "multiple-java"),
                       ("signup", "multiple-cpp")], F.lit("mbpp")).alias("task"),
            F.concat(F.lit("suite_"), (eid % 3).cast("string")).alias("suite_name"),
            F.when(et == "error", "failed").when(et == "click", "bigcode")
             .otherwise("multi_language").alias("harness"),
            F.when(F.col("value") < 10, F.lit(0.0))
             .otherwise(F.least(F.col("value") / 100, F.lit(1.0))).alias("score"),
            _k().alias("execution_time"),
            _case(eid % 4, [(0, "code_engine"), (1, "role_based"), (2, "deterministic")])
             .alias("prompting_strategy"),
            F.when(eid % 11 == 0, F.lit(None).cast("boolean"))
             .otherwise(eid % 7 == 0).alias("is_conversational"),
            "ts",
        )

    @cached_property
    def eval_samples(self) -> DataFrame:
        """One row per generation attempt of a (model, problem)."""
        li = self.table("lineitem")
        ln = F.col("l_linenumber") % 5
        passed = F.col("l_returnflag") == "R"
        return li.select(
            F.concat(F.lit("model_"), (F.col("l_suppkey") % 7).cast("string")).alias("model"),
            F.col("l_partkey").alias("problem_id"),
            _case(ln, [(0, "direct"), (1, "instruction"), (2, "conversational"), (3, "few_shot")],
                  F.lit("chain_of_thought")).alias("template"),
            F.when(F.col("l_linestatus") == "O", "python").otherwise("java").alias("language"),
            F.col("l_linenumber").alias("attempt"),
            passed.alias("passed"),
            F.when(passed, "passed").when(ln == 0, "timeout").when(ln == 1, "syntax_error")
             .when(ln == 2, "import_error").when(ln == 3, "runtime_error")
             .otherwise("failed").alias("result"),
            (F.col("l_extendedprice") / 1000).alias("execution_time"),
            F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def dated_problems(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.concat(F.lit("model_"), (F.col("o_custkey") % 5).cast("string")).alias("model"),
            F.col("o_orderkey").alias("problem_id"),
            F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("date"))
             .otherwise(F.col("o_orderdate").cast("date")).alias("release_date"),
            (F.col("o_orderstatus") == "F").alias("passed"),
            (F.col("o_totalprice") / 10000).alias("execution_time"),
        )

    @cached_property
    def model_cutoffs(self) -> DataFrame:
        """Reference data: training cutoff per model (``model_4`` left out on purpose)."""
        # fixed values
        rows = [("model_0", "1999-06-30"), ("model_1", "2000-01-31"), ("model_2", "1996-12-31"),
                ("model_3", "2001-12-31"), ("default", "1998-01-01")]
        return (self.spark.createDataFrame(rows, "model string, cutoff string")
                .select("model", F.col("cutoff").cast("date").alias("cutoff")))

    @cached_property
    def feedback(self) -> DataFrame:
        """Strategy feedback events: context vector ``x``, reward, success."""
        e = self.table("events")
        arm = (F.col("event_id") * 7 + F.col("user_id")) % 6
        return e.select(
            "event_id",
            F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"),
            F.col("user_id").alias("session_user"),
            _case(arm, [(0, "code_engine"), (1, "silent_generator"), (2, "deterministic"),
                        (3, "negative_prompt"), (4, "format_constraint")],
                  F.lit("role_based")).alias("strategy"),
            F.array(F.lit(1.0), _k() / 100, F.hour("ts").cast("double") / 24,
                    F.when(F.col("event_type") == "click", F.lit(1.0)).otherwise(F.lit(0.0))).alias("x"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("quality_score"),
            (F.col("event_type") != "error").alias("success"),
            "ts",
        )

    @cached_property
    def generations(self) -> DataFrame:
        """Generated responses with their prompts (text operators' input)."""
        p = self.table("part")
        nl = F.lit("\n")
        size = F.col("p_size").cast("string")
        pk = F.col("p_partkey")
        prompt = (F.when(pk % 5 == 0, F.concat(F.lit("def f_"), size, F.lit("(n):")))
                  .when(pk % 5 == 1, F.concat(F.lit("class C"), size, F.lit(":"), nl,
                                              F.lit("    def __init__(self):")))
                  .when(pk % 5 == 2, F.concat(F.lit("import pandas as pd"), nl,
                                              F.lit("df = pd.read_csv(path)  # "), F.col("p_name")))
                  .when(pk % 5 == 3, F.lit("SELECT * FROM users WHERE"))
                  .otherwise(F.lit("")))
        raw = (F.when(pk % 7 == 0, F.concat(F.lit("Certainly! Here is the code:"), nl, F.lit("```python"), nl,
                                            F.lit("def add(a, b):"), nl, F.lit("    return a + b"), nl,
                                            F.lit("```"), nl, nl, F.lit("This function adds "), F.col("p_name")))
               .when(pk % 7 == 1, F.concat(F.lit("def add(a, b):"), nl, F.lit("    return a + b")))
               .when(pk % 7 == 2, F.concat(F.lit("I will explain the approach for "), F.col("p_name"), F.lit(".")))
               .when(pk % 7 == 3, F.concat(F.lit("function add(a, b) {"), nl, F.lit("  return a+b;"), nl,
                                           F.lit("}"), nl, F.lit("console.log(add(1, "), size, F.lit("));")))
               .when(pk % 7 == 4, F.concat(F.lit("import os"), nl, F.lit("x = "), size, nl,
                                           F.lit('print(eval("x"))')))
               .when(pk % 7 == 5, F.concat(F.lit("# this sums"), nl, F.lit("for i in range("), size,
                                           F.lit("):"), nl, F.lit("    total = total + i"), nl, nl))
               .otherwise(F.lit("   ")))
        return p.select(
            pk.alias("gen_id"),
            F.concat(F.lit("model_"), (F.col("p_size") % 5).cast("string")).alias("model"),
            F.col("p_brand").alias("problem_id"),
            F.col("p_type").alias("category"),
            _case(pk % 3, [(0, "code_engine"), (1, "role_based")], F.lit("negative_prompt")).alias("strategy"),
            prompt.alias("prompt"),
            raw.alias("raw_text"),
            F.lit("a + b").alias("expected"),
            (pk % 10 != 0).alias("http_success"),
            (F.col("p_retailprice") / 1000).alias("execution_time"),
        )

    @cached_property
    def resource_samples(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "event_id", "ts",
            F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("host"),
            (F.col("value") % 100).alias("cpu_percent"),
            _k().alias("memory_percent"),
            (F.col("value") * 10).alias("memory_mb"),
        )

    @cached_property
    def error_log(self) -> DataFrame:
        e = self.table("events").filter(F.col("event_type") == "error")
        eid = F.col("event_id")
        return e.select(
            "event_id", "ts",
            _case(F.col("user_id") % 4, [(0, "ollama_connection"), (1, "bandit_system"), (2, "system_config")],
                  F.lit("context_analysis")).alias("component"),
            _case(eid % 5, [(0, "ConnectionError"), (1, "Timeout"), (2, "ValueError"), (3, "ImportError")],
                  F.lit("KeyError")).alias("error_type"),
            _case(eid % 4, [(0, "Connection refused"), (1, "bandit state invalid"), (2, "missing feature")],
                  F.lit("unknown")).alias("error_message"),
        )

    @cached_property
    def cache_entries(self) -> DataFrame:
        o = self.table("orders")
        ok = F.col("o_orderkey")
        return o.select(
            ok.alias("entry_id"),
            _case(ok % 3, [(0, "humaneval"), (1, "mbpp")], F.lit("multiple-js")).alias("task_name"),
            F.concat(F.lit("model_"), (F.col("o_custkey") % 5).cast("string")).alias("model_name"),
            F.when(ok % 3 == 2, "javascript").otherwise("python").alias("language"),
            F.concat(F.lit('{"limit":'), (F.col("o_custkey") % 20).cast("string"),
                     F.lit(',"verbose":true,"temperature":0.2}')).alias("parameters"),
            (F.col("o_totalprice") / 200000).alias("score"),
            (F.col("o_orderstatus") != "P").alias("success"),
            (F.col("o_totalprice") / 10000).alias("execution_time"),
            F.col("o_orderdate").alias("ts"),
            (F.col("o_custkey") % 9).alias("access_count"),
        )
