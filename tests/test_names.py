import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import models as M
from zonelens.functions import names as N

EDGE = ["www.example.com.", "example.com", "", "www.", "nodot", "xn--bcher-kva.example",
        "WWW.Example.ORG.", "a.b.c.d", "a1b2.c3", "x..y", ".", "www.www.a.", "aaaa.bbbb"]

labels = st.text(alphabet="abcxyz019-.W", min_size=0, max_size=20)


def collect(spark, values, *cols):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return df.select("s", *cols).collect()


def test_normalise_domain(spark):
    for row in collect(spark, EDGE, N.normalise_domain("s").alias("d")):
        assert row.d == M.normalise_domain(row.s)


@settings(max_examples=3, deadline=None)
@given(st.lists(labels, min_size=20, max_size=60))
def test_normalise_domain_property(spark, values):
    for row in collect(spark, values, N.normalise_domain("s").alias("d")):
        assert row.d == M.normalise_domain(row.s)


def test_relative_owner(spark):
    pairs = [("mail.a.com.", "a.com"), ("a.com.", "a.com"), ("xa.com.", "a.com"),
             ("other.test.", "a.com"), ("a.com.a.com.", "a.com"), ("b.", ""), ("x", "x")]
    df = spark.createDataFrame(pairs, "resp string, dom string")
    for r in df.select("resp", "dom", N.relative_owner("resp", "dom").alias("o")).collect():
        assert r.o == M.relative_owner(r.resp, r.dom)


def test_day_key_is_utc_and_zone_free(spark):
    df = spark.createDataFrame([(0,), (86_399_999,), (86_400_000,), (1704067199999,)], "ms long")
    got = [r.d for r in df.select(N.day_key("ms").alias("d")).collect()]
    assert got == ["19700101", "19700101", "19700102", "20231231"]


@settings(max_examples=3, deadline=None)
@given(st.lists(labels, min_size=20, max_size=60))
def test_split_and_counts(spark, values):
    p = N.split_name("s")
    rows = collect(spark, values, p.alias("p"), N.dot_count(p["rest"]).alias("dots"),
                   N.digit_count(p["rest"]).alias("dig"), N.vowel_count(p["rest"]).alias("vow"),
                   N.entropy(p["rest"]).alias("h"))
    for r in rows:
        name, tld, rest = M.split_name(r.s)
        assert (r.p.name, r.p.tld, r.p.rest) == (name, tld, rest)
        assert r.dots == rest.count(".")
        assert r.dig == sum(ch.isdigit() for ch in rest)
        assert r.vow == sum(ch in "aeiou" for ch in rest)
        assert math.isclose(r.h, M.entropy(rest), abs_tol=1e-12)


def test_split_compat_reproduces_rfind(spark):
    r = collect(spark, ["nodot"], N.split_name("s", compat=True).alias("p"))[0]
    assert (r.p.tld, r.p.rest) == ("nodot", "nodo")


def test_entropy_edge(spark):
    rows = collect(spark, ["", "aaaa", "ab", "abcd", "google"], N.entropy("s").alias("h"))
    for r in rows:
        assert math.isclose(r.h, M.entropy(r.s), abs_tol=1e-12)


def test_ratio_ideal_gtld(spark):
    df = spark.createDataFrame([("ab1", "com"), ("", "xyz"), ("aei", None)], "rest string, tld string")
    rows = df.select(N.length_per_count(N.name_length("rest"), N.digit_count("rest")).alias("r"),
                     N.entropy_ideal(N.name_length("rest")).alias("ie"),
                     N.is_gtld("tld").alias("g")).collect()
    assert rows[0].r == 3.0 and rows[1].r == 0.0
    assert math.isclose(rows[0].ie, math.log2(3)) and rows[1].ie is None
    assert [r.g for r in rows] == [1, 0, 0]


def test_round2_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    got = [r.y for r in df.select(N.round2("x").alias("y")).collect()]
    assert got == [round(0.125, 2), round(0.375, 2), 2.5]


def test_idn_keyword_filters(spark):
    df = spark.createDataFrame([("xn--a.com",), ("blog.a.com",), ("a.com",)], "d string")
    assert [r.d for r in df.filter(N.not_idn("d")).collect()] == ["blog.a.com", "a.com"]
    assert [r.d for r in df.filter(N.without_keyword("d", "blog")).collect()] == ["xn--a.com", "a.com"]


HOSTS = [" a.b.example.net x", "..Foo.COM..", "192.168.0.1", "256.1.1.1", "1.2.3", "01.2.3.4",
         "", "   ", "localhost", "a b", "1.2.3.4."]


def test_normalise_host_and_ipv4(spark):
    rows = collect(spark, HOSTS, N.normalise_host("s").alias("h"))
    for r in rows:
        assert r.h == M.normalise_host(r.s)
    rows = collect(spark, [M.normalise_host(h) for h in HOSTS], N.is_ipv4("s").alias("ip"))
    for r in rows:
        assert bool(r.ip) == M.is_ipv4(r.s)


def test_to_day(spark):
    rows = collect(spark, ["20240115", "20241301", "x"], N.to_day("s").alias("d"))
    assert str(rows[0].d) == "2024-01-15" and rows[1].d is None and rows[2].d is None
