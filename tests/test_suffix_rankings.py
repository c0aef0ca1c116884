import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import models as M
from zonelens.operators import rankings as R
from zonelens.operators import stats as S
from zonelens.operators import suffix as SUF
from zonelens.sources.readers import parse_rank

RULES = ["com", "net", "org", "example.org", "*.example.net", "!ththth.example.net", "co.uk",
         "*.uk", "// comment", ""]
HOSTS = ["www.example.com", "example.com", "com", "a.b.example.org", "example.org",
         "foo.bar.example.net", "bar.example.net", "ththth.example.net", "x.ththth.example.net",
         "shop.co.uk", "co.uk", "foo.co.uk", "a.b.zz.uk", "unknown.zz", "192.168.0.1", "256.1.1.1",
         " WWW.Example.COM. ", "", "localhost"]


def test_registrable_domain_matches_brute_force(spark):
    rules = SUF.rules_table(spark, RULES)
    clean = [r for r in RULES if r and not r.startswith("//")]
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = {r.host: r.registrable_domain for r in SUF.registrable_domain(df, rules).collect()}
    for h in HOSTS:
        assert got[h] == M.registrable(h, clean), h


def test_reference_doctest_cases(spark):
    rules = SUF.rules_table(spark, ["com"])
    df = spark.createDataFrame([("www.example.com",)], "host string")
    assert SUF.registrable_domain(df, rules).first().registrable_domain == "example.com"
    rules = SUF.rules_table(spark, ["*.uk"])
    df = spark.createDataFrame([("foo.co.uk",)], "host string")
    assert SUF.registrable_domain(df, rules).first().registrable_domain == "foo.co.uk"


def test_parse_rank(spark):
    vals = ["1", "x" * 120 + "1", "abc", "42", ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.r for r in df.select(parse_rank("s").alias("r")).collect()]
    assert got == [M.parse_rank(v) for v in vals]


def test_rank_stats_single_and_constant(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("b", 5), ("c", 1), ("c", 2), ("c", 9)],
                               "domain string, rank int")
    st = {r.domain: r for r in R.rank_stats(df).collect()}
    assert st["a"].stddev_rank is None and st["a"].skewness_rank is None
    assert st["b"].variance_rank == 0.0 and st["b"].skewness_rank is None
    x = np.array([1, 2, 9], dtype=float)
    m2 = ((x - x.mean()) ** 2).mean()
    m3 = ((x - x.mean()) ** 3).mean()
    m4 = ((x - x.mean()) ** 4).mean()
    assert math.isclose(st["c"].skewness_rank, m3 / m2 ** 1.5)
    assert math.isclose(st["c"].kurtosis_rank, m4 / m2 ** 2 - 3)
    assert math.isclose(st["c"].variance_rank, x.var(ddof=1))


def test_top_n_per_day_exactly_n(spark):
    rows = [("2024-01-01", f"d{i}.com" if i % 3 else f"google{i}.com", i) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "day string, domain string, rank int") \
              .withColumn("day", F.to_date("day"))
    out = R.top_n_per_day(df, 5, "google").orderBy("rank").collect()
    assert [r.rank for r in out] == [1, 2, 3, 4, 5]
    assert all("google" not in r.domain for r in out)
    assert [r.alexa_rank for r in out] == [1, 2, 4, 5, 7]


def test_first_day_trajectories(spark):
    rows = [("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3), ("2024-01-02", "c", 1),
            ("2024-01-03", "b", 9), ("2024-01-01", "bad", None)]
    df = spark.createDataFrame(rows, "day string, domain string, rank int").withColumn("day", F.to_date("day"))
    got = sorted((r.date, r.domain, r.rank) for r in R.first_day_trajectories(df, 2, None, k=1).collect())
    assert got == [("20240101", "a", 1), ("20240102", "a", 2)]


def test_rejected_ranks_take_no_part(spark):
    df = spark.createDataFrame([("2024-01-01", "bad.com", None), ("2024-01-01", "a.com", 5)], "day string, domain string, rank int") \
              .withColumn("day", F.to_date("day"))
    assert [(r.domain, r.rank) for r in R.top_n_per_day(df, 1).collect()] == [("a.com", 1)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_exact_quantiles_match_numpy(spark, reuse):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 50, 400), np.full(300, 7)]).astype(float)  # hot value
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        q = {r.p: r.value for r in S.exact_quantiles(df, "x", probs).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(q) == len(probs)
    for p, v in q.items():
        assert math.isclose(v, float(np.quantile(vals, p)), abs_tol=1e-9), p
    none = S.exact_quantiles(df.filter("x IS NULL"), "x").collect()
    assert [(r.p, r.value) for r in none] == [(0.25, None), (0.5, None), (0.75, None)]


def test_exact_quantiles_of_millions_of_distinct_values(spark):
    df = spark.range(3_000_000).select((F.pow(F.rand(7) * 2 - 1, 3) * 1e8 + F.col("id") * 1e-3).alias("x")).repartition(8)
    probs = (0.001, 0.25, 0.5, 0.75, 0.9999)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        exact = df.agg(F.percentile("x", list(probs)).alias("q")).first()["q"]
        got = S.exact_quantiles(df, "x", probs)
        assert "Checkpoint" not in got._jdf.queryExecution().toString()
        assert {r.p: r.value for r in got.collect()} == pytest.approx(dict(zip(probs, exact)), rel=1e-12)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 5.0), (100.0, None, 2.0), (None, 1.0, 9.0), (7.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    exp = df.toPandas().corr()
    got = {(r.a, r.b): r.r for r in S.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {k: pytest.approx(exp.loc[k]) for k in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (2, 5, 4.0), (3, 5, 6.5)], "a int, b int, c double")
    out = {(r.a, r.b): r.r for r in S.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] is None
    assert math.isclose(out[("a", "c")], float(np.corrcoef([1, 2, 3], [2.0, 4.0, 6.5])[0, 1]))


def test_t_pvalue_known_values():
    # two-sided p of Student's t: t=2.228, df=10 -> 0.05; t=1.96, df=1e6 -> ~0.05
    assert abs(S.t_pvalue(2.228, 10) - 0.05) < 1e-3
    assert abs(S.t_pvalue(1.959964, 1e6) - 0.05) < 1e-4
    assert S.t_pvalue(0.0, 5) == 1.0


def test_sample_n_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    a = [r.k for r in S.sample_n(df, 10, seed=1, key="k").collect()]
    b = [r.k for r in S.sample_n(df, 10, seed=1, key="k").collect()]
    c = [r.k for r in S.sample_n(df, 10, seed=2, key="k").collect()]
    assert a == b and len(a) == 10 and a != c


def test_describe_numeric_matches_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(3.0, 0.7, 300), np.full(100, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = S.describe_numeric(df, "x").first()
    exp = pd.Series(vals).describe()
    assert got["count"] == int(exp["count"])
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                         ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert math.isclose(got[ours], float(exp[theirs]), rel_tol=1e-9, abs_tol=1e-12), ours


def test_point_biserial_report(spark):
    rng = np.random.default_rng(5)
    flag = rng.integers(0, 2, 200)
    val = rng.normal(0, 1, 200) + 0.5 * flag
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(flag, val)], "f int, v double")
    rep = S.point_biserial_report(df, "f", "v")
    r = float(np.corrcoef(flag, val)[0, 1])
    assert math.isclose(rep["r"], r, rel_tol=1e-9) and rep["n"] == 200
    t = r * math.sqrt(198 / (1 - r * r))
    assert math.isclose(rep["t"], t, rel_tol=1e-9)
    assert 0.0 <= rep["p"] < 0.05  # a real effect of half a standard deviation


def test_point_biserial_p_is_a_column_and_nulls_are_left_out(spark):
    rows = [(0, 1.0), (0, 2.0), (0, 4.0), (1, 4.0), (1, 5.0), (None, 9.0), (1, None)]
    r = S.point_biserial(spark.createDataFrame(rows, "f int, v double"), "f", "v").first()
    full = [x for x in rows if None not in x]
    rr = float(np.corrcoef(*zip(*full))[0, 1])
    t = rr * math.sqrt(3 / (1 - rr * rr))
    # Student's t with 3 degrees of freedom in closed form
    p = 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))
    assert (r["r"], r["t"], r["n"], r["p"]) == (pytest.approx(rr), pytest.approx(t), 5, pytest.approx(p))


def test_exact_quantiles_of_few_distinct_values(spark):
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    for n in (*range(1, 51), 58, 59, 499, 998, 10_000, 10_001):
        vals = np.random.default_rng(n).permutation(n) ** 2 / 7.0
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        got = {r.p: r.value for r in S.exact_quantiles(df, "x", probs).collect()}
        assert got == pytest.approx(dict(zip(probs, np.quantile(vals, probs))), rel=1e-12), n
