import json

from pyspark.sql import functions as F

import models as M
from zonelens.functions import records as RF
from zonelens.functions.names import normalise_domain
from zonelens.operators import records as REC
from zonelens.plans import jobs as J
from zonelens.schemas import pad_to_observation_schema


def _obs_rows(fx):
    return [r.asDict() for r in fx.observations.collect()]


def test_record_line_matches_model(fx):
    got = {r.event_id: r.line for r in fx.observations.withColumn("domain", normalise_domain("query_name")).select(
        "event_id", RF.record_line().alias("line")).collect()}
    for r in _obs_rows(fx):
        assert got[r["event_id"]] == M.record_line(r, M.normalise_domain(r["query_name"]))


def test_record_line_none_payload_and_other(spark):
    df = spark.createDataFrame(
        [("www.a.com.", "MX", "a.com.", None, "mx.a.com."), ("a.com.", "NSHASH", "a.com.", None, None),
         ("a.com.", "A", None, None, None)],
        "query_name string, response_type string, response_name string, mx_preference int, "
        "mx_address string")
    df = pad_to_observation_schema(df)
    got = [r.l for r in df.withColumn("domain", normalise_domain("query_name")).select(RF.record_line().alias("l")).collect()]
    assert got == ["@ MX None mx.a.com.", "a.com. NSHASH", None]


def test_compact_records_matches_model(fx):
    expected = {}
    for r in _obs_rows(fx):
        dom = M.normalise_domain(r["query_name"])
        import datetime
        date = datetime.datetime.fromtimestamp(r["timestamp"] / 1000, datetime.UTC).strftime("%Y%m%d")
        line = M.record_line(r, dom)
        expected.setdefault((dom, date), set())
        if line is not None:
            expected[(dom, date)].add(line)
    got = {(r.domain, r.date): r.records for r in REC.compact_records(fx.observations).collect()}
    assert set(got) == set(expected)
    for k, lines in expected.items():
        assert got[k] == sorted(lines, key=lambda x: (x.split(" ")[1], x))
    assert any(v == [] for v in got.values()), "groups without records keep []"


def test_type_counts_both_modes(fx):
    sets = REC.compact_records(fx.observations)
    strict = {(r.domain, r.date): r for r in REC.record_features(sets, "strict").collect()}
    text = {(r.domain, r.date): r for r in REC.record_features(sets, "text").collect()}
    differ = 0
    for r in sets.collect():
        joined = ";".join(r.records)
        for t in RF.COUNTED_TYPES:
            assert strict[(r.domain, r.date)][t] == sum(1 for x in r.records if x.split(" ")[1] == t)
            assert text[(r.domain, r.date)][t] == joined.count(f" {t} ")
            differ += strict[(r.domain, r.date)][t] != text[(r.domain, r.date)][t]
    assert differ > 0, "the fixture has payloads that the text mode counts (K7)"


def test_prune_falsy_drops_null_empty_zero(spark):
    df = spark.createDataFrame([("A", "", 0, 5, None)], "a string, b string, c int, d int, e string")
    rec = json.loads(df.select(RF.prune_falsy(df).alias("j")).first().j)
    assert rec == {"a": "A", "d": 5}


def test_group_records_multiplicity(spark):
    rows = [("www.a.com.", 1704067200000, "A", "a.com.", 0),
            ("a.com.", 1704067300000, "A", "a.com.", 0),
            ("a.com", 1704067400000, "NS", "a.com.", 1)]
    df = spark.createDataFrame(rows, "query_name string, timestamp long, response_type string, "
                                     "response_name string, status_code int")
    out = REC.group_records(df, nested=True).collect()
    assert len(out) == 1 and out[0].domain == "a.com" and out[0].date == "20240101"
    recs = {r.record: r.n for r in out[0].records}
    assert {(r.domain, r.date, r.record): r.n for r in REC.group_records(df).collect()} == {("a.com", "20240101", k): n for k, n in recs.items()}
    assert sum(recs.values()) == 3 and len(recs) == 3  # query names differ


def test_month_features_join(fx):
    out = J.month_features(fx.rankings, fx.observations)
    assert out.count() > 0
    assert out.columns[:4] == ["domain", "date", "alexa_rank", "records_count"]
