import pytest
from pyspark.sql import functions as F

from evalspark.operators import passk


def _samples(spark, per_problem, model="m"):
    rows = [(model, pid, i, bool(ok)) for pid, res in enumerate(per_problem) for i, ok in enumerate(res)]
    return spark.createDataFrame(rows, "model string, problem_id int, attempt int, passed boolean")


@pytest.mark.parametrize("n,c,k,expected", [
    (10, 3, 1, 0.3), (200, 50, 1, 0.25), (10, 3, 5, 0.9166666667), (200, 50, 10, 0.9479063706),
    (3, 0, 3, 0.0), (5, 5, 1, 1.0), (4, 1, 10, 1.0),
])
def test_pk1_goldens(spark, n, c, k, expected):
    df = spark.createDataFrame([(n, c)], "n int, c int")
    got = df.select(passk.pass_at_k_expr("n", "c", k).alias("p")).first().p
    assert got == pytest.approx(expected, abs=1e-9)


def test_pk2_monotone_and_any_success(spark):
    import random
    rnd = random.Random(7)
    probs = [[rnd.random() < 0.3 for _ in range(5)] for _ in range(10)]
    s = _samples(spark, probs)
    out = {r.k: r.pass_at_k for r in passk.pass_at_k(s, ["model"], (1, 2, 3, 5)).collect()}
    assert out[1] <= out[2] <= out[3] <= out[5]
    # with n = k, pass@k is "any success"
    assert out[5] == pytest.approx(sum(any(p) for p in probs) / len(probs))
    assert out[1] == pytest.approx(sum(sum(p) for p in probs) / 50)


def test_pk4_report_counts_and_interval(spark):
    import random
    rnd = random.Random(1)
    probs = [[rnd.random() < 0.5 for _ in range(5)] for _ in range(10)]
    s = _samples(spark, probs)
    rows = passk.pass_at_k_report(s, ["model"], (1, 5), n_boot=500).collect()
    for r in rows:
        assert r.num_problems == 10 and r.total_samples == 50
        assert r.ci_low <= r.pass_at_k <= r.ci_high
    # reproducible by seed
    again = passk.pass_at_k_report(s, ["model"], (1, 5), n_boot=500).collect()
    assert sorted((r.k, r.ci_low, r.ci_high) for r in rows) == sorted((r.k, r.ci_low, r.ci_high) for r in again)


def test_pk4_all_fail_all_pass(spark):
    fail = _samples(spark, [[False] * 4] * 3, "fail")
    ok = _samples(spark, [[True] * 4] * 3, "ok")
    rows = passk.pass_at_k_report(fail.unionByName(ok), ["model"], (1, 2, 4), n_boot=100).collect()
    for r in rows:
        exp = 0.0 if r.model == "fail" else 1.0
        assert r.pass_at_k == exp and r.ci_low == exp and r.ci_high == exp


def test_pk4_empty(spark):
    s = spark.createDataFrame([], "model string, problem_id int, attempt int, passed boolean")
    assert passk.pass_at_k_report(s, ["model"], (1,), n_boot=10).count() == 0


def test_pk3_width_close_to_normal_interval(spark):
    # large group: bootstrap 95% width within 15% of the normal approximation
    import math
    import random
    rnd = random.Random(3)
    probs = [[rnd.random() < 0.4] for _ in range(4000)]
    s = _samples(spark, probs)
    r = passk.pass_at_k_bootstrap(s, ["model"], (1,), n_boot=2000).first()
    p = sum(x[0] for x in probs) / len(probs)
    normal = 2 * 1.96 * math.sqrt(p * (1 - p) / len(probs))
    assert abs((r.ci_high - r.ci_low) - normal) / normal < 0.15


def test_pk5_variants(spark):
    s = _samples(spark, [[True, False, False, False]])
    std = {r.k: r.pass_at_k for r in passk.pass_at_k_plugin(s, ["model"], (1, 4, 5)).collect()}
    real = {r.k: r.pass_at_k for r in passk.pass_at_k_plugin(s, ["model"], (1, 4, 5), variant="real").collect()}
    assert std[1] == pytest.approx(0.25)
    assert std[4] == pytest.approx(1 - 0.75 ** 4)   # k == n: formula
    assert real[4] == pytest.approx(0.25)            # k >= n: c/n
    assert std[5] == pytest.approx(0.25)


def test_pk6_plugin_bootstrap_degenerate(spark):
    s = _samples(spark, [[True] * 6])
    agg = passk.pass_at_k_plugin(s, ["model"], (1, 3)).select("model", "n", "c", "k")
    for r in passk.plugin_bootstrap(agg, ["model"], n_boot=100).collect():
        assert r.ci_low == 1.0 and r.ci_high == 1.0


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"model", "k", "pass_at_k", "ci_low", "ci_high", "rank"} <= set(df.columns)


def test_draws_have_the_right_distribution(spark):
    """Normal quantiles against the standard library, Poisson quantiles against their
    definition for small means and their moments for large ones, draws against their text."""
    import hashlib
    import math
    import statistics

    from pyspark.sql import functions as F
    from evalspark.functions import draws

    u = F.col("u")
    df = spark.createDataFrame([(x,) for x in (1e-9, 0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.9999)], "u double")
    for r in df.select("u", draws.normal_quantile(u, u - 0.5, (u - 0.5) * (u - 0.5)).alias("z")).collect():
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.u), abs=1e-7)
    rows = spark.range(4000).selectExpr("id", "explode(array(0, 1, 3, 16, 17, 400, 1000000)) as mean")
    got = draws.with_poisson(rows, {"x": (F.col("mean"), draws.uniform(F.lit("s"), F.col("mean"), F.col("id")))})
    for r in got.groupBy("mean").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).collect():
        assert abs(r.m - r["mean"]) <= 4 * math.sqrt(max(r["mean"], 1e-9) / 4000) + 1e-9
        assert r.v == pytest.approx(r["mean"], rel=0.12)
    one = got.where("mean = 3 and id = 7").first()
    p = (int(hashlib.md5(b"s|3|7").hexdigest()[:13], 16) + 0.5) / (1 << 52)
    k, total = 0, math.exp(-3)
    while total < p:
        k += 1
        total += math.exp(-3) * 3 ** k / math.factorial(k)
    assert one.x == k
