"""Layouts, one-pass ingestion, places in a total order, radix selection, co-moments."""

import datetime as dt
import gzip
import json
import math
import random
import re
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonelens.functions import records as RF
from zonelens.functions import txt as TF
from zonelens.operators import order as O
from zonelens.operators import rankings as R
from zonelens.operators import records as REC
from zonelens.operators import stats as S
from zonelens.sources import readers as RD
from zonelens.sources import sinks as SK


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_rewritten_alone(spark, scratch):
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    rows = spark.createDataFrame([(i, days[i % 10]) for i in range(100)], "id long, day date")
    SK.write_by_day(rows, scratch + "/d", col="day")
    SK.rewrite_days(rows.where("day IN (DATE'2024-01-02', DATE'2024-01-03') AND id < 50").withColumn("id", F.col("id") + 1000),
                    scratch + "/d", days[1:4])
    back = RD.read_days(spark, scratch + "/d", "id long")
    got = {d: sorted(r.id for r in back.where(F.col("day") == d).collect()) for d in days}
    assert got[days[0]] == list(range(0, 100, 10)) and got[days[9]] == list(range(9, 100, 10))
    assert got[days[1]] == [1001 + 10 * k for k in range(5)] and got[days[2]] == [1002 + 10 * k for k in range(5)]
    assert got[days[3]] == []  # run again, without rows
    some = RD.filter_days(back, ["20240105", "20240106"])
    assert "PartitionFilters: [" in _plan(some) and "day" in _plan(some) and some.count() == 20


def test_bucketed_join_shuffles_nothing(spark, fx, scratch):
    SK.write_bucketed(REC.with_keys(fx.observations), "zl_test_obs", 4, ("domain", "date"), path=scratch + "/obs")
    SK.write_bucketed(REC.rankings_by_date(fx.rankings), "zl_test_ranks", 4, ("domain", "date"), path=scratch + "/ranks")
    try:
        out = REC.join_bucketed(spark.table("zl_test_ranks"), spark.table("zl_test_obs"))
        plan = _plan(out)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = REC.join_rank_records(REC.rankings_by_date(fx.rankings), REC.record_counts(fx.observations))
        assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.sql("DROP TABLE IF EXISTS zl_test_obs")
        spark.sql("DROP TABLE IF EXISTS zl_test_ranks")


def test_ingest_reads_once_and_keeps_rejected_lines(spark, scratch):
    good = {"query_type": "A", "query_name": "a.com.", "timestamp": 1704067200000, "worker_id": 1, "status_code": 0}
    lines = [json.dumps(good), "{broken", json.dumps(good | {"timestamp": 1704153600000}), "", "[1, 2]",
             json.dumps({k: v for k, v in good.items() if k not in ("status_code", "worker_id")}), json.dumps(good | {"timestamp": "x"})]
    with gzip.open(scratch + "/raw.json.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = RD.ingest_observations(spark, scratch + "/raw.json.gz", scratch + "/out")
    counts = {r.reason: r.n for r in got.counts.collect()}
    assert counts["worker_id is missing"] == 1 and counts["status_code is missing"] == 1
    assert got.accepted.count() == got.kept == 2 and {str(r.day) for r in got.accepted.collect()} == {"2024-01-01", "2024-01-02"}
    bad = {r.line: r.reasons for r in got.quarantine.collect()}
    assert bad["{broken"] == ["malformed line"] and got.total == got.kept + len(bad)
    one = [k for k, v in bad.items() if v == ["worker_id is missing", "status_code is missing"]]
    assert len(one) == 1 and json.loads(one[0])["query_name"] == "a.com."
    day = RD.ingest_observations(spark, scratch + "/raw.json.gz", scratch + "/day", days=["20240102"])
    assert [str(r.day) for r in day.accepted.collect()] == ["2024-01-02"] and day.kept == 1 and day.quarantine.count() == len(bad)


def test_places_and_parts_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 30}", i % 50 if i % 7 else None, f"v{i:04d}") for i in range(3000)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    placed = sorted(map(tuple, O.numbered(df, "g", "k", "v").select("position", "g", "k", "v").collect()))
    key = lambda r: (r[0], (r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""))
    assert [p[1:] for p in placed] == sorted(rows, key=key) and [p[0] for p in placed] == list(range(len(rows)))
    parts = O.ordered_parts(df, ("g",), ("k", "v"), F.col("v"), 64)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r.g, r.part)):
        assert len(r["values"]) <= 64
        got.setdefault(r.g, []).append(r["values"])
    for g in {r[0] for r in rows}:
        want = [r[2] for r in sorted(rows, key=key) if r[0] == g and r[2] is not None]
        assert [v for part in got[g] for v in part] == want and all(len(p) == 64 for p in got[g][:-1])
    assert O.numbered(df.where("false"), "g").count() == 0


def test_ordered_key_is_the_order_of_doubles(spark):
    rng = random.Random(5)
    vals = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1 - 2 ** -53, 4 - 2 ** -51]
    vals += [math.nextafter(2.0 ** k, to) for k in range(-1070, 1023, 31) for to in (0, math.inf)]
    vals += [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)]
    for v, k in spark.createDataFrame([(v,) for v in vals], "v double").select("v", F.expr(O.ordered_key("v"))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (0 if v == 0 else 0x7FF8000000000000 if v != v else -bits if v < 0 else bits), v


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 11, 50])
def test_quartiles_of_short_columns(spark, n):
    vals = np.random.RandomState(n).normal(size=n) * 1e6
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r.p: r.value for r in S.exact_quantiles(df, "x").collect()}
    assert all(math.isclose(got[p], np.quantile(vals, p), rel_tol=1e-14, abs_tol=1e-9) for p in got)


def test_correlations_with_null_patterns_and_far_means(spark):
    rng = np.random.RandomState(3)
    n, cols = 4000, ["a", "b", "c", "d", "e", "f"]
    x = rng.normal(size=(n, 6))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=n)
    x[:, 2] = 1.7e12 + 3e6 * x[:, 0]  # like epoch milliseconds: sums of squares would cancel
    x[:, 5] = 7.0  # constant
    df = pd.DataFrame(x, columns=cols)
    for c in "abd":
        df.loc[rng.rand(n) < 0.3, c] = np.nan
    df["e"] = np.where(np.arange(n) % 2, df["e"], np.nan)
    df["g"] = np.arange(n) % 2
    rows = [tuple(None if v != v else float(v) for v in r) for r in df.itertuples(index=False)]
    sdf = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in df.columns)).repartition(6)
    for size in (6, 5, 2):
        use = cols[:size]
        got = {(r.a, r.b): r.r for r in S.correlation_matrix(sdf, use).collect()}
        want = df[use].corr()
        assert set(got) == {(a, b) for i, a in enumerate(use) for b in use[i + 1:]}
        for (a, b), r in got.items():
            assert r is None if "f" in (a, b) else abs(r - want.loc[a, b]) < 1e-9, (a, b)
    by = {(r.g, r.a, r.b): r.r for r in S.correlation_matrix(sdf, ["a", "b", "e"], ("g",)).collect()}
    for g in (0.0, 1.0):
        assert abs(by[g, "a", "b"] - df[df.g == g][["a", "b"]].corr().iloc[0, 1]) < 1e-9
    assert (0.0, "a", "e") not in by  # no row has both


def test_labels_equal_their_patterns(spark):
    """The conditions against the patterns themselves, on texts made of their parts."""
    rng = random.Random(11)
    heads = [p for ps in TF.TXT_TAXONOMY.values() for pat in ps for p in (TF.literal_prefixes(pat) or [])]
    bits = heads + [h.upper() for h in heads] + ["\\", "_", "\n", " ", "=", "==", "a", "Z", "9", "|", "&m", "i=123", "onmicrosoft.com", "^", "-", "é", "K", "ı"]
    runs = ["0123456789abcdef" * 5, "Ab1+" * 25, "abcdefghijklmnopqrstuvwxyz" * 4, "123456789-1234567", "01234567-89ab-cdef-0123-456789abcdef"]
    texts = {"", "i=123&mx", "9|x", "i=12&m", "MS\nx", "x onmicrosoft.com\n", "a\nonmicrosoft.com", "v=dKim1", "v=dKim1"}
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 3)))
        if rng.random() < .6:
            r = rng.choice(runs)
            t += r[:rng.choice([26, 32, 40, 41, 42, 43, 64, 86, len(r), rng.randint(0, 90)])] + rng.choice(["", "=", "==", "\n", "=\n", "==\n"])
        texts.add(t)
    label = " , ".join(f"CASE WHEN t RLIKE r'{TF.label_regex(x)}' THEN '{x}' END" for x in TF.TXT_TAXONOMY)
    rows = spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "t string").select(
        "t", TF.txt_labels("t").alias("got"), F.expr(f"filter(array({label}), x -> x IS NOT NULL)").alias("want")).collect()
    assert [(r.t, r.got) for r in rows if r.t is not None] == [(r.t, r.want) for r in rows if r.t is not None]
    assert set().union(*(r.got for r in rows if r.t is not None)) == set(TF.TXT_TAXONOMY)


def test_text_counts_are_sums_over_lines(spark, fx):
    sets = REC.compact_records(fx.observations)
    want = {(r.domain, r.date): tuple(r[2:]) for r in REC.record_features(sets, "text").collect()}
    got = REC.record_counts(fx.observations, "text").select("domain", "date", "records_count", *RF.COUNTED_TYPES)
    assert {(r.domain, r.date): tuple(r[2:]) for r in got.collect()} == want
    assert "collect" not in _plan(got)


def test_record_parts_join_to_record_sets(fx):
    want = {(r.domain, r.date): r.records for r in REC.compact_records(fx.observations).collect()}
    got = {}
    for r in sorted(REC.record_parts(fx.observations, 3).collect(), key=lambda r: (r.domain, r.date, r.part)):
        assert len(r.records) <= 3
        got.setdefault((r.domain, r.date), []).extend(r.records)
    assert got == want


def test_trajectories_of_a_hundred_thousand_names(spark):
    top = spark.range(300_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("domain"), (F.col("id") % 1000).alias("rank"))
    names = spark.range(100_000).select(F.concat(F.lit("n"), (F.col("id") * 2).cast("string")).alias("domain"))
    out = R.trajectory(top, names)
    assert out.columns == ["domain", "rank"] and out.count() == 100_000
    assert R.trajectory(top, ["n1", "n7"]).count() == 2


def test_sample_of_every_band(spark):
    df = spark.range(2000).select(F.concat(F.lit("d"), F.col("id")).alias("domain"), (F.col("id") / 500.0).alias("entropy"))
    bands = {"low": (0.0, 1.0, True, False), "all": (0.0, None, False, False), "none": (9.0, None, True, False)}
    got = S.sample_bands(df, bands, 6, seed=3)
    assert "WindowGroupLimit" in _plan(got)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.band, []).append(r.domain)
    one = S.sample_n(S.entropy_band(df, 0.0, 1.0, lo_closed=True), 6, seed=3, key="domain")
    assert sorted(rows["low"]) == sorted(r.domain for r in one.collect()) and len(rows["all"]) == 6 and "none" not in rows
    assert re.fullmatch("d[0-9]+", rows["all"][0])
