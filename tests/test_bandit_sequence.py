"""Bandit goldens, sequence primitives against plain windows, tail probabilities."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions import tails
from evalspark.operators import bandit as BD
from evalspark.operators import sequence as SQ
from evalspark.operators import stats


def _feedback(spark, n=600, seed=5):
    rnd = random.Random(seed)
    arms = {"code_engine": 0.9, "deterministic": 0.5, "role_based": 0.1}
    rows = []
    for i in range(n):
        arm = list(arms)[i % 3]
        x = [1.0, rnd.random(), rnd.random()]
        r = min(1.0, max(0.0, arms[arm] + rnd.gauss(0, 0.05)))
        rows.append((i, "m", arm, x, r, r > 0.3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}"))
    return spark.createDataFrame(rows, "event_id long, model string, strategy string, x array<double>, "
                                       "quality_score double, success boolean, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))


def test_bd2_finds_best_and_worst_arm(spark):
    fb = _feedback(spark)
    solved = BD.solve_arms(BD.arm_statistics(fb, 3), 3)
    scored = BD.score_contexts(fb, solved, 3, alpha=0.1)
    best = scored.groupBy("best_arm").count().orderBy(F.desc("count")).first().best_arm
    assert best == "code_engine"
    worst = (scored.select(F.explode("arm_scores").alias("s")).groupBy("s.arm").agg(F.avg("s.predicted").alias("p"))
             .orderBy("p").first().arm)
    assert worst == "role_based"


def test_bd1_additive_and_bd3_matches_final_state(spark):
    fb = _feedback(spark, 120)
    st = {r.strategy: r for r in BD.arm_statistics(fb, 3).collect()}
    assert sum(r["count"] for r in st.values()) == 120
    # BD-3 at the last event of an arm == BD-1 state minus that event (scores from A and b before it)
    rep = BD.replay_scores(fb, 3, alpha=1.0).filter("strategy = 'code_engine'").orderBy(F.desc("arm_seq")).first()
    assert rep.arm_seq == st["code_engine"]["count"]
    assert math.isfinite(rep.ucb) and rep.width > 0


@pytest.mark.parametrize("chunk", [7, 1000])
def test_prefix_sums_equal_window(spark, chunk):
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), f"2024-01-0{1 + i % 9} 00:00:{i % 60:02d}", i, rnd.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts string, id long, v long").withColumn("ts", F.to_timestamp("ts"))
    got = SQ.prefix_sums(df, ["k"], ["ts", "id"], {"v": F.col("v")}, rows_per_chunk=chunk)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).alias("seq"),
                    F.sum("v").over(w).alias("cum_v"))
    a = sorted((r.id, r.seq, r.cum_v) for r in got.select("id", "seq", "cum_v").collect())
    b = sorted((r.id, r.seq, r.cum_v) for r in exp.collect())
    assert a == b


def test_global_midranks(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("t"))
    got = {r.v: r.midrank for r in stats.distinct_value_ranks(df, "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0, 5.0: 7.0}


def test_kruskal_h_and_p(spark):
    a = [2.9, 3.0, 2.5, 2.6, 3.2]
    b = [3.8, 2.7, 4.0, 2.4, 3.1]
    c = [2.8, 3.4, 3.7, 2.2, 2.0]
    rows = [(v, "a") for v in a] + [(v, "b") for v in b] + [(v, "c") for v in c]
    r = stats.kruskal_wallis(spark.createDataFrame(rows, "v double, g string"), "v", "g").first()
    assert r.h == pytest.approx(0.98)  # ranks: a 37, b 48, c 35 -> 0.05 * 4898 / 5 - 48
    assert r.p_value == pytest.approx(math.exp(-r.h / 2), rel=1e-9)


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    assert tails.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-6)
    assert tails.chi2_sf(7.814727903251178, 3) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_two_sided(2.228138851986274, 10) == pytest.approx(0.05, rel=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_two_proportion_zero_variance(spark):
    rows = [("a", True)] * 4 + [("b", True)] * 3
    r = stats.two_proportion_test(spark.createDataFrame(rows, "model string, passed boolean"), "model").first()
    assert r.p_value == 1.0 and r.z_score == 0.0 and r.effect_size == 0.0


def test_chunks_split_ties_of_the_first_column(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 10 < 9 then 1.0 else rand(3) end as score", "'k' as k")
    for keys in (["k"], []):
        sizes = [r["count"] for r in SQ.with_chunks(rows, keys, ["score", "id"], rows_per_chunk=1000).groupBy("_chunk").count().collect()]
        assert max(sizes) <= 2000 and len(sizes) >= 15
    got = SQ.prefix_sums(rows, [], ["score", "id"], {"one": F.lit(1)}, rows_per_chunk=1000)
    assert got.where("seq <> cum_one").count() == 0 and got.select("seq").distinct().count() == 20_000
    first = got.orderBy("seq").select("score", "id").collect()
    assert [tuple(r) for r in first] == sorted(tuple(r) for r in first)


def test_prefix_sums_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan")
    SQ.prefix_sums(spark.range(10).selectExpr("id", "id % 2 as k"), ["k"], ["id"])
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("", "")


def test_quantiles_equal_percentile_with_ties_and_nulls(spark):
    from evalspark.operators.quantiles import quantiles

    df = spark.range(3000).selectExpr("case when id % 7 = 0 then null else pow(id % 97, 1.5) end as v", "case when id % 3 < 2 then 'a' when id < 4 then 'b' end as k")
    got = {r.k: (r.lo, r.mid, r.hi) for r in quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).collect()}
    exp = {r.k: tuple(r.p) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.93))).alias("p")).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert got[k] == pytest.approx(exp[k], rel=1e-12)
