"""Edge cases: empty input, one row, one group, ties,
zero variance, zero denominators."""

from pyspark.sql import functions as F

from evalspark.operators import aggs, contamination, ranking, stats
from evalspark.operators import documents as DX

RES = "model string, task string, score double, execution_time double, ts timestamp_ntz"


def _res(spark, rows):
    return aggs.preprocess_results(spark.createDataFrame(rows, RES))


def test_histogram_all_equal_values_one_bin(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    r = _res(spark, [("m", "humaneval", 0.5, 1.0, t)] * 4)
    h = {x.bin: x["count"] for x in aggs.score_histogram(r).collect()}
    assert len(h) == 20 and h[1] == 4 and sum(h.values()) == 4


def test_empty_results(spark):
    r = _res(spark, [])
    assert aggs.model_statistics(r).count() == 0
    assert ranking.model_ranking(r).count() == 0
    assert stats.kruskal_wallis(r, "score", "model").count() == 0
    assert stats.score_trend(r).count() == 0
    s = aggs.summary_statistics(r).first()
    assert s.total == 0 and s.score_mean is None


def test_one_row_std_is_null_and_one_group_no_test(spark):
    import datetime as dt
    r = _res(spark, [("m", "humaneval", 0.7, 2.0, dt.datetime(2024, 1, 1))])
    row = aggs.model_statistics(r).first()
    assert row.sample_size == 1 and row.std_score is None
    assert stats.kruskal_wallis(r, "score", "model").count() == 0   # fewer than two groups


def test_kruskal_all_values_equal_is_undefined(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "humaneval", 0.5, 1.0, t)] * 5 + [("b", "humaneval", 0.5, 1.0, t)] * 5
    k = stats.kruskal_wallis(_res(spark, rows), "score", "model").first()
    assert k.h is None


def test_suite_summary_zero_successes(spark):
    import datetime as dt
    r = _res(spark, [("m", "humaneval", 0.0, 3.0, dt.datetime(2024, 1, 1))] * 3)
    s = aggs.suite_model_summary(r.withColumn("suite_name", F.lit("s")), ["suite_name", "model"]).first()
    assert s.successful_tasks == 0 and s.average_score == 0.0 and s.average_time == 0.0 and s.success_rate == 0.0


def test_temporal_report_no_clean_problems(spark):
    import datetime as dt
    probs = spark.createDataFrame([("m", 1, dt.date(1990, 1, 1), True), ("m", 2, None, False)],
                                  "model string, problem_id int, release_date date, passed boolean")
    cut = spark.createDataFrame([("default", dt.date(1995, 1, 1))], "model string, cutoff date")
    r = contamination.temporal_report(probs, cut).first()
    assert r.clean_problems == 0 and r.pass_at_1 == 0.0 and r.contamination_status == "UNKNOWN"
    assert r.full_set_pass_at_1 == 0.5


def test_confusion_zero_denominators(spark):
    df = spark.createDataFrame([(False, False)] * 3, "t boolean, p boolean")
    r = DX.confusion_metrics(F.col("t"), F.col("p"), df).first()
    assert r.tn == 3 and r.precision is None and r.recall is None and r.mcc is None and r.specificity == 1.0


def test_ties_break_by_name(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    r = _res(spark, [("b", "humaneval", 0.5, 1.0, t), ("a", "humaneval", 0.5, 1.0, t)])
    assert [x.model for x in ranking.model_ranking(r).orderBy("position").collect()] == ["a", "b"]
    g = ranking.best_worst_gap(r).first()
    assert g.best == "a" and g.worst == "b" and g.gap == 0.0


def test_report_flows(spark, views):
    from evalspark.plans import reports
    from evalspark.sources import reference_data as ref
    rep = reports.analytics_report(views.eval_results)
    assert rep["summary_statistics"].count() == 1
    assert rep["model_ranking"].count() == rep["model_statistics"].count()
    sr = reports.suite_report(aggs.preprocess_results(views.eval_results), ref.suites_df(spark), "standard")
    # every expected (model, task) pair is present after completion
    exp = {(r.model, r.task) for r in sr["expected"].select("model", "task").collect()}
    got = {(r.model, r.task) for r in sr["completed"].select("model", "task").distinct().collect()}
    assert exp <= got
    levels = {r.level for r in sr["summary"].select("level").distinct().collect()}
    assert levels == {"suite_model", "task", "harness", "all"}


# ------------------------------------------------------------------ rows that must not get lost
def test_io1_keeps_the_numbers_beside_a_text_metric(spark, tmp_path):
    import json

    from evalspark.sources import io

    doc = {"suite_name": "s", "results": [{"task": "t", "model": "m", "score": "0.5", "metrics": {"pass@1": 0.25, "note": "text"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"task": "u"}, {"task": "v", "metrics": None}]}))
    got = {r.task: (r.metrics, r.suite_name) for r in io.read_suite_results(spark, str(tmp_path)).collect()}
    assert got == {"t": ({"pass@1": 0.25, "note": None}, "s"), "u": (None, "unknown"), "v": (None, "unknown")}


def test_io3_a_partly_read_record_is_rejected_not_lost(spark, tmp_path):
    from pyspark.sql import types as T

    from evalspark.sources import io

    (tmp_path / "x.jsonl").write_text('{"event_id":1,"value":2}\n{"event_id":2,"value":"abc"}\n{broken\n')
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    good, bad = io.read_json_dataset(spark, str(tmp_path), schema)
    assert [r.event_id for r in good.collect()] == [1] == [r.event_id for r in good.select("event_id").collect()]
    assert sorted(r._corrupt_record for r in bad.collect()) == ['{"event_id":2,"value":"abc"}', "{broken"]


def test_io9_language_runs_stay_whole(spark):
    from evalspark.sources import io

    logs = spark.createDataFrame([("r1", 1, '{"results": {"task": {"acc": 0.5, "alias": "a"}}}'), ("r2", 1, "accuracy: 0.7"), ("r3", 1, "nothing")],
                                 "run_id string, line_no int, line string")
    got = {(r.run_id, r.metric, r.value) for r in io.parse_harness_logs(logs, "language").collect()}
    assert got == {("r1", "task.acc", 0.5), ("r2", "extracted_score", 0.7), ("r3", None, None)}
    code = spark.createDataFrame([("r1", 1, '{"pass@1": 0.5, "note": "x"}')], "run_id string, line_no int, line string")
    assert ("r1", "pass@1", 0.5) in {(r.run_id, r.metric, r.value) for r in io.parse_harness_logs(code, "code").collect()}


def test_jn6_jn7_keep_rows_without_default_or_model(spark):
    from evalspark.operators import joins

    cutoffs = spark.createDataFrame([("m", "2023-01-01")], "model string, cutoff string").selectExpr("model", "cast(cutoff as date) cutoff")
    rows = spark.createDataFrame([(1, "m", "2024-01-01"), (2, None, "2024-01-01"), (3, "other", None)], "id int, model string, release_date string")
    rows = rows.selectExpr("id", "model", "cast(release_date as date) release_date")
    got = {r.id: r.clean for r in joins.temporal_split(rows, cutoffs).collect()}
    assert got == {1: True, 2: None, 3: None}
    assert joins.resolve_cutoff(rows.select("model").distinct(), cutoffs).count() == 3


def test_bandit_refuses_contexts_of_another_length(spark):
    import pytest

    from evalspark.operators import bandit as BD

    fb = spark.createDataFrame([("m", "a", [1.0, 2.0], 0.5, True), ("m", "a", [1.0, 2.0, 3.0], 0.5, True)],
                               "model string, strategy string, x array<double>, quality_score double, success boolean")
    with pytest.raises(Exception, match="2 components"):
        BD.arm_statistics(fb, 2).collect()
    assert BD.arm_statistics(spark.createDataFrame([fb.first()], fb.schema), 2).first()["count"] == 1


def test_ss5_takes_late_new_keys(spark, tmp_path):
    from evalspark.streaming import streams as SS

    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-01 12:00:00", 2), ("c", "2024-01-01 09:00:00", 3), ("a", "2024-01-01 08:00:00", 4)],
                                 "k string, ts string, v int").selectExpr("k", "cast(ts as timestamp) ts", "v")
    src = str(tmp_path / "in")
    for v in (1, 2, 3, 4):
        rows.where(f"v = {v}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    SS.stream_upsert(stream, "k", str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r.k: r.v for r in SS.current_upsert_table(spark, str(tmp_path / "out"), "k").collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_dx1_needs_equal_words_not_equal_hashes(spark):
    from evalspark.operators import documents as DX

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "B C D!"), (8, "q r s")], "item_id int, text string")
    got = [tuple(r) for r in DX.ngram_contamination(docs, items, 3).select("doc_id", "item_id", "shared_ngrams", "item_ngrams").collect()]
    assert got == [(1, 7, 1, 1)]


def test_pj11_code_is_part_of_the_key(spark):
    import hashlib

    from evalspark.operators import ops

    df = spark.createDataFrame([(1, "t", "m", "Python", '{"n_samples": 5, "debug": true}', "x = 1"), (2, "t", "m", "Python", '{"n_samples": 5}', "x = 2"),
                                (3, "t", "m", "Python", '{"n_samples": 5}', None), (4, "t", "m", "Python", None, "")],
                               "id int, task_name string, model_name string, language string, parameters string, code string")
    plain = {r.id: r.cache_key for r in ops.cache_key(df).collect()}
    coded = {r.id: r.cache_key for r in ops.cache_key(df, code="code").collect()}
    assert plain[1] == plain[2] == plain[3] and len({coded[1], coded[2], coded[3]}) == 3
    assert coded[3] == plain[3] and coded[4] == plain[4]
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert coded[1] == hashlib.sha256(f"t|m|python|{short('n_samples=5')}|{short('x = 1')}".encode()).hexdigest()


def test_jn8_reads_each_side_once(spark, views):
    from evalspark.operators import ops

    keyed = ops.cache_key(views.cache_entries).select("entry_id", "cache_key", "ts")
    plan = ops.cache_lookup_flags(keyed.select("entry_id", "cache_key"), keyed, "1998-08-02", 86400)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_null_groups_are_kept(spark):
    """AG-13, AG-16, PK-4, WN-9, LR-5, WN-11: a NULL group has its row."""
    from evalspark.operators import aggs, learning, ops, passk, ranking, responses

    n = 12
    base = spark.range(2 * n).withColumn("model", F.when(F.col("id") % 2 == 0, "m")).withColumns({
        "success": F.col("id") % 3 == 0, "is_conversational": F.lit(False), "strategy": F.lit("direct"), "execution_time": F.lit(1.0), "ts": F.col("id").cast("timestamp"),
        "event_id": F.col("id"), "quality_score": F.col("id").cast("double"), "problem_id": F.col("id") % 4, "passed": F.col("id") % 3 == 0, "severity": F.lit("critical"),
        "name": F.lit("f"), "signature": F.lit("f()"), "body": F.lit("x")})
    for df in (aggs.model_benchmark_summary(base), responses.function_analysis(base, ["model"]), passk.pass_at_k_report(base, ["model"], (1,), with_interval=True, n_boot=10),
               ranking.early_late_delta(base, ["model"], "quality_score", ["ts", "event_id"]), learning.strategy_evolution(base), ops.health_check(base, by=["model"])):
        assert sorted(str(r["model"]) for r in df.collect()) == ["None", "m"]
