"""Parity of the Spark expressions with the plain-Python models on
Hypothesis-generated rows (B3, B4, B5, B6, B11, B19, B24, B29, C3).  Each example is
a batch of rows evaluated in one Spark job."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import models as M
from zonelens.functions import records as RF
from zonelens.functions import txt as TF
from zonelens.functions.names import entropy, normalise_domain, relative_owner
from zonelens.operators import suffix as SUF
from zonelens.schemas import pad_to_observation_schema
from zonelens.sources.readers import parse_rank

FAST = settings(max_examples=4, deadline=None)
label = st.sampled_from(["a", "b", "www", "mail", "ab", "x1", "co", "uk", "com", "example", "net"])
name = st.lists(label, min_size=1, max_size=4).map(".".join)
maybe = lambda s: st.one_of(st.none(), s)


@FAST
@given(st.lists(st.tuples(name.map(lambda x: x + "."), name), min_size=30, max_size=60))
def test_relative_owner_parity(spark, pairs):
    df = spark.createDataFrame(pairs, "resp string, dom string")
    for r in df.select("resp", "dom", relative_owner("resp", "dom").alias("o")).collect():
        assert r.o == M.relative_owner(r.resp, r.dom)


TYPES = ["SOA", "NS", "AAAA", "A", "TXT", "SPF", "PTR", "CNAME", "MX", "RRSIG", "DS", "DNSKEY",
         "CAA", "NSEC", "DNAME", "NSHASH", None]
row = st.fixed_dictionaries({
    "query_name": st.tuples(st.booleans(), name).map(lambda t: ("www." if t[0] else "") + t[1] + "."),
    "response_type": st.sampled_from(TYPES),
    "response_name": maybe(name.map(lambda x: x + ".")),
    "ns_address": maybe(name), "ip4_address": maybe(st.just("10.0.0.1")),
    "txt_text": maybe(st.text(alphabet="ab \"=", max_size=8)),
    "mx_preference": maybe(st.integers(0, 50)), "mx_address": maybe(name),
    "soa_serial": maybe(st.integers(0, 2 ** 40)), "soa_mname": maybe(name),
    "rrsig_key_tag": maybe(st.integers(0, 65535)), "rrsig_signer_name": maybe(name),
    "ds_digest": maybe(st.just("abc")), "caa_tag": maybe(st.just("issue")),
    "nsec_next_domain_name": maybe(name), "dnskey_flags": maybe(st.integers(0, 300)),
})
ROW_DDL = ("query_name string, response_type string, response_name string, ns_address string, "
           "ip4_address string, txt_text string, mx_preference int, mx_address string, "
           "soa_serial bigint, soa_mname string, rrsig_key_tag int, rrsig_signer_name string, "
           "ds_digest string, caa_tag string, nsec_next_domain_name string, dnskey_flags int")
COLS = [c.split()[0] for c in ROW_DDL.split(", ")]


@FAST
@given(st.lists(row, min_size=40, max_size=80))
def test_record_line_parity(spark, rows):
    df = pad_to_observation_schema(
        spark.createDataFrame([tuple(r[c] for c in COLS) for r in rows], ROW_DDL))
    got = [r.l for r in df.withColumn("domain", normalise_domain("query_name")).select(RF.record_line().alias("l")).collect()]
    for r, line in zip(rows, got):
        assert line == M.record_line(r, M.normalise_domain(r["query_name"]))


@FAST
@given(st.lists(st.one_of(st.integers(-5, 10 ** 6).map(str), st.text(alphabet="0123x ", max_size=130)),
                min_size=30, max_size=60))
def test_parse_rank_parity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", parse_rank("s").alias("r")).collect():
        assert r.r == M.parse_rank(r.s), r.s


@FAST
@given(st.lists(st.text(alphabet="abcé.-12 ", max_size=40), min_size=30, max_size=60))
def test_entropy_parity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", entropy("s").alias("h")).collect():
        assert math.isclose(r.h, M.entropy(r.s), abs_tol=1e-12)


PREFIXES = ["v=spf1 ", "include:", "MS=", "ms", "google-site-verification=", "k=rsa", "ALIAS for ",
            "1|", "i=123&m", "MAlt", "docusign", "ppe-", "", "spf2.0/", "V=DKIM1", "pardot_"]
text = st.tuples(st.sampled_from(PREFIXES), st.text(alphabet="abcdef0123456789ABZ=-/+", max_size=90)) \
         .map("".join)


def _labels(t):
    out = []
    for lbl, pats in TF.TXT_TAXONOMY.items():
        if any(re.match(p[4:], t, re.I) if p.startswith("(?i)") else re.match(p, t) for p in pats):
            out.append(lbl)
    return out


@FAST
@given(st.lists(text, min_size=40, max_size=80))
def test_txt_labels_parity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for r in df.select("t", TF.txt_labels("t").alias("l")).collect():
        assert r.l == _labels(r.t), r.t


line = st.tuples(st.sampled_from(["@", "www", "a.b"]), st.sampled_from(TYPES[:-1]),
                 st.text(alphabet="A NSX", max_size=6)).map(lambda t: " ".join(t))


@FAST
@given(st.lists(st.lists(line, max_size=6), min_size=20, max_size=40))
def test_type_counts_parity(spark, sets):
    df = spark.createDataFrame([(s,) for s in sets], "records array<string>")
    strict = df.select(*RF.type_counts("records", "strict")).collect()
    text_ = df.select(*RF.type_counts("records", "text")).collect()
    for recs, a, b in zip(sets, strict, text_):
        joined = ";".join(recs)
        for t in RF.COUNTED_TYPES:
            assert a[t] == sum(1 for x in recs if x.split(" ")[1] == t)
            assert b[t] == joined.count(f" {t} ")


RULES = ["com", "net", "org", "example.org", "*.example.net", "!ththth.example.net", "co.uk", "*.b.a"]
host = st.lists(st.sampled_from(["a", "b", "ththth", "example", "net", "org", "com", "co", "uk", "zz",
                                 "1", "255", "300"]), min_size=1, max_size=5).map(".".join)


@FAST
@given(st.lists(host, min_size=30, max_size=60))
def test_registrable_domain_parity(spark, hosts):
    rules = SUF.rules_table(spark, RULES)
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = SUF.registrable_domain(df, rules).select("host", "registrable_domain").collect()
    for r in got:
        assert r.registrable_domain == M.registrable(r.host, RULES), r.host
    assert len(got) == len(hosts)
    assert df.select(F.count("*")).first()[0] == len(hosts)


falsy_row = st.tuples(maybe(st.sampled_from(["", "a", "xyz", "0"])), maybe(st.integers(-2, 2)),
                      maybe(st.sampled_from([0, 7, 2 ** 40])), maybe(st.text(alphabet='ab"\\/', max_size=4)))


@FAST
@given(st.lists(falsy_row, min_size=30, max_size=60))
def test_prune_falsy_parity(spark, rows):
    import json
    df = spark.createDataFrame(rows, "s string, i int, l bigint, t string")
    got = [json.loads(r.j) for r in df.select(RF.prune_falsy(df).alias("j")).collect()]
    for row, obj in zip(rows, got):
        assert obj == {k: v for k, v in zip(("s", "i", "l", "t"), row) if v}


def _short(r):
    t, resp = r["response_type"], r["response_name"]
    if not t:
        return "Unknown response type"
    payload = {"A": r.get("ip4_address"), "AAAA": r.get("ip6_address"),
               "CNAME": r.get("cname_name")}.get(t, resp)
    return "%s %s %s" % (resp, t, payload)


short_row = st.fixed_dictionaries({
    "response_type": st.sampled_from(["A", "AAAA", "CNAME", "NS", "", None]),
    "response_name": maybe(name), "ip4_address": maybe(st.just("10.0.0.1")),
    "ip6_address": maybe(st.just("2001:db8::1")), "cname_name": maybe(name)})


@FAST
@given(st.lists(short_row, min_size=30, max_size=60))
def test_short_line_parity(spark, rows):
    cols = ["response_type", "response_name", "ip4_address", "ip6_address", "cname_name"]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows],
                               ", ".join(f"{c} string" for c in cols))
    got = [x.l for x in df.select(RF.short_line().alias("l")).collect()]
    assert got == [_short(r) for r in rows]
