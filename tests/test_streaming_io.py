"""Stream = batch (S checks) and file sources/sinks on small fixtures."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import bandit as BD
from evalspark.operators import learning as LR
from evalspark.sources import io
from evalspark.streaming import streams as SS


def _stream(spark, df, slices=3):
    path = tempfile.mkdtemp(prefix="evalspark-stage-") + "/data"
    SS.stage_in_time_slices(df, path, slices)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ss2_equals_bd1(spark, views):
    fb = views.feedback
    d = 4
    got = {(r.model, r.strategy): r for r in SS.run_to_table(SS.stream_arm_statistics(_stream(spark, fb), d)).collect()}
    exp = {(r.model, r.strategy): r for r in BD.arm_statistics(fb, d).collect()}
    assert got.keys() == exp.keys()
    for k, e in exp.items():
        g = got[k]
        assert g["count"] == e["count"] and g.successes == e.successes
        assert g.a_packed == pytest.approx(e.a_packed, rel=1e-12)
        assert g.b == pytest.approx(e.b, rel=1e-12)


def _phase_positions(feedback):
    return {(r.model, ph): r[f"{ph}_at"] for r in LR.phase_path(feedback).collect()
            for ph in ("balanced", "exploitation", "refinement") if r[f"{ph}_at"] is not None}


def test_ss6_equals_lr4(spark, views):
    fb = views.feedback.select("event_id", "model", "success", "ts")
    trans = SS.run_to_table(SS.stream_phase(_stream(spark, SS.with_heartbeat(fb))), "append").collect()
    assert {(r.model, r.to_phase): r.seq for r in trans} == _phase_positions(views.feedback)


def test_ss6_does_not_depend_on_batches(spark):
    """Rows shuffled over many micro-batches, ties in time, a NULL model, a model in its last phase early."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.2 + i / 900, f"2024-01-01 {i // 400:02d}:{i // 7 % 57:02d}:00") for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id long, model string, success boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = _phase_positions(df)
    path = tempfile.mkdtemp(prefix="evalspark-stage-") + "/data"
    schema = df.schema
    order = sorted(rows, key=lambda r: r[0] + rng.randrange(150))  # a row comes up to 150 rows late
    for k in range(0, 1200, 130):
        spark.createDataFrame(order[k:k + 130], "event_id long, model string, success boolean, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    SS.with_heartbeat(df).where("event_id is null").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = SS.run_to_table(SS.stream_phase(stream, "3 hours"), "append").collect()
    assert {(r.model, r.to_phase): r.seq for r in got} == want and len(got) == len(want) and len(want) > 4
    by_seq = {}
    for m in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == m), key=lambda r: (r[3], r[0]))
        by_seq |= {(m, i + 1): r[3] for i, r in enumerate(own)}
    assert all(str(r.ts) == by_seq[r.model, r.seq] for r in got)


def test_ss4_sessions_match_batch(spark, views):
    fb = views.feedback.select("event_id", "session_user", "success", "quality_score", "ts")
    st = SS.run_to_table(SS.stream_sessions(_stream(spark, fb)), "append")
    batch = LR.session_rollup(views.feedback)
    s = {(r.session_user, r.session_start): r.interactions for r in st.collect()}
    b = {(r.session_user, r.session_start): r.interactions for r in batch.collect()}
    # append mode emits the sessions the final watermark has closed: all of them match the batch
    assert s and all(b.get(k) == v for k, v in s.items())
    assert len(s) >= len(b) - views.feedback.select("session_user").distinct().count()


def test_ss5_upsert_keeps_newest(spark):
    rows = [("k1", 1, "2024-01-01 00:00:00", 1.0), ("k1", 2, "2024-01-01 01:00:00", 2.0),
            ("k2", 3, "2024-01-01 00:30:00", 3.0), ("k2", 4, "2024-01-01 02:00:00", 4.0)]
    df = spark.createDataFrame(rows, "key string, id long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    out = tempfile.mkdtemp(prefix="evalspark-upsert-")
    q = SS.stream_upsert(_stream(spark, df, 2), "key", out, tie="id", checkpoint=out + "_ck")
    q.awaitTermination()
    got = {r.key: r.id for r in SS.current_upsert_table(spark, out, "key", tie="id").collect()}
    assert got == {"k1": 2, "k2": 4}


def test_ss5_compacts(spark, monkeypatch):
    """Many batches, late rows and repeats: the table is the batch result, a read sees
    few runs, and a batch that is run again changes nothing."""
    import random

    monkeypatch.setattr(SS, "MERGE", 3)
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(12)}", i, f"2024-01-01 {rng.randrange(24):02d}:00:00", float(i)) for i in range(140)]
    df = spark.createDataFrame(rows, "key string, id long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    src, out = tempfile.mkdtemp(prefix="evalspark-stage-") + "/data", tempfile.mkdtemp(prefix="evalspark-upsert-") + "/t"
    for k in range(0, 140, 10):
        df.where(f"id >= {k} and id < {k + 10}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    SS.stream_upsert(stream, "key", out, tie="id", checkpoint=out + "_ck").awaitTermination()
    want = {k: max(((r[2], r[1]) for r in rows if r[0] == k)) [1] for k in {r[0] for r in rows}}
    read = lambda: {r.key: r.id for r in SS.current_upsert_table(spark, out, "key", tie="id").collect()}
    assert read() == want
    assert SS.current_runs(spark, out) == [(0, 8), (9, 11), (12, 12), (13, 13)]  # 14 batches
    assert not any(b - a == 0 and b < 9 for a, b in SS._runs(spark, out))  # swept behind the second tier
    # the last batch once more, as after a failure before its commit
    commits = sorted((int(f) for f in os.listdir(out + "_ck/commits") if f.isdigit()))
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(f"{out}_ck/commits/{name}")
    SS.stream_upsert(stream, "key", out, tie="id", checkpoint=out + "_ck").awaitTermination()
    assert read() == want and SS.current_runs(spark, out)[-1] == (13, 13)


def test_io1_reads_reference_shaped_documents(spark):
    d = tempfile.mkdtemp(prefix="evalspark-io-")
    doc = {"suite_name": "quick", "timestamp": 1727000000.0, "total_tasks": 2,
           "results": [{"harness": "bigcode", "task": "humaneval", "model": "m", "score": 0.5,
                        "metrics": {"pass@1": 0.5, "pass@10": 0.7}, "metadata": {}, "execution_time": 3.2},
                       {"harness": "failed", "task": "mbpp", "model": "m", "score": "bad", "metrics": {},
                        "execution_time": None}]}
    with open(os.path.join(d, "suite_a.json"), "w") as f:
        json.dump(doc, f, indent=2)
    doc2 = {"results": [{"task": "multiple-js", "model": "n", "score": 1}]}
    with open(os.path.join(d, "suite_b.json"), "w") as f:
        json.dump(doc2, f)
    from evalspark.operators.aggs import preprocess_results
    r = preprocess_results(io.read_suite_results(spark, d), metric_keys=["pass@1", "pass@10"]).orderBy("task").collect()
    assert [x.task for x in r] == ["humaneval", "mbpp", "multiple-js"]
    assert r[0]["pass@10"] == 0.7 and r[0].language == "python"
    assert r[1].score == 0.0 and r[1].success is False            # bad number -> 0
    assert r[2].suite_name == "unknown" and r[2].timestamp is not None  # defaults: name, file time
    assert r[0].timestamp.year == 2024


def test_io3_rejects_kept(spark):
    d = tempfile.mkdtemp(prefix="evalspark-io-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"id": 1, "v": 2.0}\nnot json\n{"id": 3, "v": 4.5}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    good, bad = io.read_json_dataset(spark, d, schema)
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert [r._corrupt_record for r in bad.collect()] == ["not json"]


def test_io4_flatten(spark):
    rows = [("m", [("t1", "x", [("s1", True), ("s2", False)]), ("t2", "y", [("s1", False)])])]
    df = spark.createDataFrame(rows, "model string, test_cases array<struct<test_name:string, expected:string, "
                                     "results:array<struct<strategy:string, success:boolean>>>>")
    out = io.flatten_strategy_results(df).collect()
    assert [(r.test_name, r.strategy, r.success) for r in out] == [("t1", "s1", True), ("t1", "s2", False),
                                                                   ("t2", "s1", False)]


def test_io6_write_organized(spark):
    rows = [("metrics", "2024-09-09", "m1", "humaneval"), ("metrics", "2024-09-10", "m2", "mbpp"),
            ("suite", "2024-09-09", None, None)]
    df = spark.createDataFrame(rows, "type string, date string, model string, benchmark string")
    paths = io.write_organized(df, tempfile.mkdtemp(prefix="evalspark-org-"))
    assert spark.read.parquet(paths["by_model"]).filter("model = 'm1'").count() == 1
    assert spark.read.parquet(paths["by_benchmark"]).count() == 2
    assert spark.read.parquet(paths["suites"]).count() == 1


def test_io6_computes_its_rows_once(spark):
    computed = spark.sparkContext.accumulator(0)
    rows = [("metrics", "2024-09-09", "m1", "humaneval"), ("generations", "2024-09-10", None, "mbpp"),
            ("suite", "2024-09-09", None, None)]

    def counted(row):
        computed.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(counted), "type string, date string, model string, benchmark string")
    paths = io.write_organized(df, tempfile.mkdtemp(prefix="evalspark-org-"))
    assert computed.value == 3
    assert [spark.read.parquet(paths[k]).count() for k in ("by_date", "by_model", "by_benchmark", "suites")] == [2, 2, 2, 1]
    assert not df.is_cached


def test_io5_works_out_a_name_once(spark):
    names = ["suite_m_1725868800.json", "metrics_m_1725868800.json", "generations_1725868800_mbpp.json", "generations_x.json", "other.json", None]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, n string").select("id", F.concat("n", F.lit("")).alias("file_name"), F.lit("{}").alias("content"))
    found = io.catalog_result_files(files)
    assert found.columns == ["id", "file_name", "content", "type", "timestamp", "date", "model", "benchmark"]
    assert [(r.id, r.type, r.timestamp, r.benchmark) for r in found.filter("type != 'suite'").orderBy("id").collect()] == [
        (1, "metrics", "1725868800", "unknown"), (2, "generations", "1725868800", "mbpp")]
    plan = found.filter("type != 'suite'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_io9_language_harness(spark):
    lines = [("r1", 1, "loading"), ("r1", 2, '{"results": {"hellaswag": {"acc": 0.41, "acc_norm": 0.52}}}'),
             ("r1", 3, '{"results": {"other": {"acc": 0.9}}}'),
             ("r2", 1, "final accuracy: 0.33 after 12.5 steps"), ("r2", 2, "score 7")]
    df = spark.createDataFrame(lines, "run_id string, line_no int, line string")
    got = {(r.run_id, r.metric): r.value for r in io.parse_harness_logs(df, "language").collect()}
    assert got == {("r1", "hellaswag.acc"): 0.41, ("r1", "hellaswag.acc_norm"): 0.52,
                   ("r2", "extracted_score"): 12.5}


def test_io9_code_harness_json_wins(spark):
    lines = [("r", 1, "pass@1: 0.40 pass@10: 0.70"), ("r", 2, 'summary {"pass@1": 0.45}'), ("r", 3, "pass@1: 0.50"),
             ("e", 1, "nothing here")]
    df = spark.createDataFrame(lines, "run_id string, line_no int, line string")
    got = {(r.run_id, r.metric): r.value for r in io.parse_harness_logs(df, "code").collect()}
    assert got[("r", "pass@1")] == 0.45 and got[("r", "pass@10")] == 0.70
    assert got[("e", "pass@1")] == 0.0
