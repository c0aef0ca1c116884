import re

from pyspark.sql import functions as F

import models as M
from zonelens.functions import txt as TF
from zonelens.operators import soa as SOA
from zonelens.operators import txt as T

TEXTS = ['"v=spf1 include:a.com -all"', "MS=ms123", "ms=lower", "google-site-verification=x",
         "_google-site-verification=y", '""', None, "private Login a.com", "ALIAS for a.com",
         "0123456789abcdef0123456789abcdef", "v=dkim1; k=rsa", "4|a.com", "note A record here",
         "  ", "spf2.0/pra a.com", "x.onmicrosoft.com", "x.onmicrosoft.com\n", "\\v=spf1",
         "i=123&m=1", "MAlt", "123456789-1234567", "A" * 86 + "==", "abcdefghijklmnopqrstuvwxyz",
         "12345678-1234-1234-1234-123456789abc", "Include:foo", "SPF1 upper"]


def model_labels(text):
    out = []
    for label, patterns in TF.TXT_TAXONOMY.items():
        for p in patterns:
            flags = re.IGNORECASE if p.startswith("(?i)") else 0
            if re.match(p[4:] if flags else p, text, flags):
                out.append(label)
                break
    return out


def test_txt_labels_match_python_re(spark):
    cleaned = [M.clean_txt(t) for t in TEXTS]
    df = spark.createDataFrame([(t,) for t in cleaned], "t string")
    for r in df.select("t", TF.txt_labels("t").alias("l")).collect():
        assert r.l == model_labels(r.t), r.t


def test_clean_and_labels_and_sensitive(spark):
    df = spark.createDataFrame([("TXT", t) for t in TEXTS] + [("A", "x")], "rt string, t string")
    rows = df.select("rt", "t", TF.clean_txt("t").alias("c"), TF.record_labels("rt", "t").alias("l"),
                     TF.is_sensitive(TF.clean_txt("t")).alias("s")).collect()
    for r in rows:
        assert (r.c or "") == M.clean_txt(r.t)
        exp = ["dns"] + (["txt"] if r.rt == "TXT" else [])
        if r.rt == "TXT" and M.clean_txt(r.t):
            exp.append("correct_txt")
        assert r.l == exp
        words = ("login", "user", "password", "pswd", "private")
        assert bool(r.s) == any(re.search(w, r.c or "", re.IGNORECASE) for w in words)


def test_compat_none_counts_as_correct(spark):
    df = spark.createDataFrame([("TXT", None)], "response_type string, txt_text string") \
              .withColumn("day", F.current_date())
    assert T.txt_basic(df).first().correct_txt == 0
    assert T.txt_basic(df, compat=True).first().correct_txt == 1


def test_soa_ranges_bounds_and_compat(spark):
    rows = [(72000, 3600, 2700000, 129600), (72001, 3601, 2700001, 129601),
            (100799, 10799, 3599999, 215999), (100800, 10800, 3600000, 216000), (None, None, None, None)]
    df = spark.createDataFrame(rows, "soa_refresh long, soa_retry long, soa_expire long, soa_minimum long") \
              .withColumn("day", F.lit("d"))
    r = SOA.soa_ranges(df).first()
    for t in ("refresh", "retry", "expire", "minimum"):
        assert r[f"in_range_{t}"] == 2 and r[f"below_{t}"] == 1 and r[f"above_{t}"] == 1
    c = SOA.soa_ranges(df, compat=True).first()
    # K2: refresh bounds applied to soa_expire values: none fall in (72000, 100800)
    assert c.in_range_refresh == 0


def test_category_rollup_levels(fx):
    counts = T.txt_label_counts(fx.observations)
    roll = T.category_rollup(counts)
    per_day = roll.filter(F.col("level") == 3).select("day", "n").collect()
    tot = {r.day: r.n for r in counts.groupBy("day").agg(F.sum("n").alias("n")).collect()}
    assert {r.day: r.n for r in per_day} == tot


def test_both_taxonomies_agree_on_every_label(spark):
    """The Spark patterns and the DuckDB patterns label the fixture's texts alike,
    and the fixture has a text for each label."""
    import duckdb

    from zonelens.functions.txt import TXT_TAXONOMY
    from zonelens.plans.bindings import Fixture
    from zonelens.plans.oracle_sql import txt_labels_sql
    texts = sorted({r.t for r in Fixture(spark, "/root/testdata/sf0.01").observations.select(
        TF.clean_txt("txt_text").alias("t")).filter("t <> ''").collect()} | {"", "v=spf", "xmalt", "k=RSA", "\nMS=1", "MS\nx", "9|\n"})
    got = {r.t: set(r.l) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", TF.txt_labels("t").alias("l")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x(t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?)", [(t,) for t in texts])
    assert got == {t: set(l) for t, l in con.execute(f"SELECT t, {txt_labels_sql('t')} FROM x").fetchall()}
    assert set().union(*got.values()) == set(TXT_TAXONOMY)
