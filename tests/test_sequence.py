"""Chunked order: bounds, borders and plans of the ordered primitives and their users."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.operators import bandit, documents, learning
from evalspark.operators import sequence as SQ

MODES = ["exploration", "direct", "role_based", "code_engine"]


def _feedback(spark, n=900, seed=3):
    """A hot model, a small one and a NULL one; ties in ts."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        model = rnd.choice(["hot"] * 8 + ["small", None])
        rows.append((i, model, f"u{rnd.choice([0, 0, 0, 1])}" if i % 11 else None, rnd.choice(MODES), round(rnd.random(), 3), rnd.random() < 0.35 + i / n / 2,
                     rnd.choice([1, 2, 40, 0]) if i % 9 else 0))
    minutes, out = 0, []
    for i, m, u, s, q, ok, gap in rows:
        minutes += gap
        out.append((i, m, u, s, q, ok, minutes * 60))
    return spark.createDataFrame(out, "event_id long, model string, session_user string, strategy string, quality_score double, success boolean, t long") \
        .withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def _rows(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["lr1", "lr4", "bd4"])
def test_chunks_do_not_change_results(spark, name):
    fb = _feedback(spark).cache()
    run = {"lr1": lambda r: learning.session_rollup(fb, rows_per_chunk=r), "lr4": lambda r: learning.phase_path(fb, window=20, rows_per_chunk=r),
           "bd4": lambda r: bandit.diversity_flags(fb, MODES, window=7, min_history=3, rows_per_chunk=r)}[name]
    whole = _rows(run(10_000))
    assert whole == _rows(run(45))
    key = "session_user" if name == "lr1" else "model"
    assert None in {r[key] for r in run(45).select(key).distinct().collect()}  # a NULL group is a group


def test_sessions_equal_a_loop(spark):
    fb = _feedback(spark, 500)
    want = {}
    rows = sorted(fb.collect(), key=lambda r: (str(r["session_user"]), r["ts"], r["event_id"]))
    last = None
    for r in rows:
        if last is None or last["session_user"] != r["session_user"]:
            no = 0
        if no == 0 or (r["ts"] - last["ts"]).total_seconds() >= 1800:
            no += 1
        want.setdefault((r["session_user"], no), []).append(r)
        last = r
    got = {(r["session_user"], r["session_no"]): r for r in learning.session_rollup(fb, rows_per_chunk=40).collect()}
    assert got.keys() == want.keys()
    for k, own in want.items():
        q = [r["quality_score"] for r in own]
        gain = sum(q[-5:]) / 5 - sum(q[:5]) / 5 if len(q) >= 10 else 0.0
        assert got[k]["interactions"] == len(q) and abs(got[k]["improvement_rate"] - gain) < 1e-9
        assert (got[k]["session_start"], got[k]["session_end"]) == (own[0]["ts"], own[-1]["ts"])


def test_phase_path_equals_a_loop(spark):
    fb = _feedback(spark, 1200, seed=8)
    for model in ("hot", "small", None):
        own = sorted((r for r in fb.collect() if r["model"] == model), key=lambda r: (r["ts"], r["event_id"]))
        state, at = 0, {}
        for i in range(1, len(own) + 1):
            last = own[max(0, i - 20):i]
            if state < 3 and i >= learning.TRANSITIONS[state][2] and sum(r["success"] for r in last) / len(last) >= learning.TRANSITIONS[state][3]:
                at[learning.TRANSITIONS[state][1]] = i
                state += 1
        got = next(r for r in learning.phase_path(fb, window=20, rows_per_chunk=60).collect() if r["model"] == model)
        assert {k: got[f"{k}_at"] for k in ("balanced", "exploitation", "refinement") if got[f"{k}_at"]} == at
        assert got["final_phase"] == (["exploration", *at])[-1]


def test_feedback_signals_over_chunk_borders(spark):
    rnd = random.Random(2)
    said = ["thanks", "no, i meant x", "same", "same", "here's the file", None, "plain"]
    rows = [(rnd.choice([1, 1, 1, 2, None]), t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(said)) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = documents.feedback_signals(df)
    want = []
    for conv in (1, 2, None):
        own = [r for r in rows if r[0] == conv]
        for k, (_, turn, role, _) in enumerate(own):
            after = [r for r in own[k + 1:] if r[2] == "user"]
            if role == "assistant" and after:
                prior = [r for r in own[:own.index(after[0])] if r[2] == "user"]
                text, before = after[0][3], prior[-1][3] if prior else None
                want.append((conv, turn, text == "no, i meant x" if text else None, text is not None and text == before))
    for df_ in (whole, documents.feedback_signals(df, rows_per_chunk=25)):
        got = df_.collect()
        assert sorted(((r["conv_id"], r["assistant_turn"], r["user_corrected"]) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
        assert {(r["conv_id"], r["assistant_turn"]) for r in got if r["user_frustrated"]} == {w[:2] for w in want if w[3]}


def test_chunks_follow_the_rows(spark):
    """Over 128 chunks, 90 % ties in the first column: no chunk is empty, short or large."""
    df = spark.range(60_000).selectExpr("id", "if(id % 10 < 9, 1.0D, cast(id % 7 as double)) as score", "cast(null as string) as k")
    for keys in ([], ["k"]):
        sizes = [r["count"] for r in SQ.with_chunks(df, keys, ["score", "id"], rows_per_chunk=200, least=16).groupBy("_chunk").count().collect()]
        assert len(sizes) == 300 and sum(sizes) == 60_000
        assert 16 <= min(sizes) and max(sizes) < 200 * 2.5
    got = SQ.prefix_sums(df, [], ["score", "id"], {"one": F.lit(1)}, rows_per_chunk=200)
    assert got.where("seq <> cum_one").count() == 0
    want = df.select("id", F.row_number().over(Window.orderBy("score", "id")).alias("seq"))
    assert got.select("id", "seq").exceptAll(want).count() == 0


def test_bounds_search_levels(spark):
    """A search through three levels equals the count of bounds below."""
    levels = "transform(sequence(1, 9000), i -> struct(i * 3 as o0))"
    row = spark.sql(f"select {levels} as _l2").withColumn("_l1", F.expr("transform(sequence(64, size(_l2), 64), i -> _l2[i - 1])")).withColumn("_l0", F.expr("transform(sequence(64, size(_l1), 64), i -> _l1[i - 1])"))
    probe = row.crossJoin(spark.sql("select explode(sequence(0, 27100, 17)) as x")).select("x", SQ._search(["_l0", "_l1", "_l2"], F.struct(F.col("x").alias("o0"))).alias("at"))
    assert all(r["at"] == min(9000, r["x"] // 3) for r in probe.collect())


def test_rows_of_equal_order_stay_together(spark):
    """Rows that tie in the whole order tuple cannot be split and are not lost."""
    df = spark.range(5000).selectExpr("id", "cast(if(id < 4500, 0, id) as long) as o")
    got = SQ.prefix_sums(df, [], ["o"], rows_per_chunk=100)
    assert sorted(r["seq"] for r in got.collect()) == list(range(1, 5001))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _row_moves(df, column):
    """Exchanges below which a row-sized column still travels."""
    return [line for line in _plan(df).splitlines() if "Exchange hashpartitioning(" in line and column in line]


def test_rows_move_once(spark, tmp_path):
    """No checkpoint, and one hash exchange by (key, chunk) of the rows themselves."""
    path = str(tmp_path / "fb")
    _feedback(spark).write.parquet(path)
    fb = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (learning.session_rollup(fb), learning.phase_path(fb), bandit.diversity_flags(fb, MODES)):
            plan = _plan(df)
            assert "Scan ExistingRDD" not in plan  # what a checkpoint leaves
            by_chunk = [line for line in plan.splitlines() if "Exchange hashpartitioning(_key" in line and "_chunk" in line and "ENSURE_REQUIREMENTS" in line]
            by_seq = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "seq#" in line]
            assert by_chunk and not by_seq
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
