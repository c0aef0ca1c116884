import gzip
import io
import json
import os
import tarfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from zonelens.operators import records as REC
from zonelens.operators import suffix as SUF
from zonelens.plans.registry import QUERIES
from zonelens.sources import readers as RD
from zonelens.sources import sinks as SK


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_observations_permissive(spark, scratch):
    p = os.path.join(scratch, "day", "part-0.json.gz")
    os.makedirs(os.path.dirname(p))
    good = {"query_type": "A", "query_name": "www.a.com.", "response_type": "A",
            "response_name": "a.com.", "timestamp": 1704067200000, "worker_id": 1,
            "status_code": 0, "ip4_address": "10.0.0.1"}
    with gzip.open(p, "wt") as f:
        f.write(json.dumps(good) + "\n{not json\n")
    df = RD.read_observations(spark, os.path.join(scratch, "day"))
    rows = df.collect()
    assert len(rows) == 2
    assert len(df.columns) == 102
    ok = [r for r in rows if r["_corrupt_record"] is None][0]
    assert ok["ip4_address"] == "10.0.0.1" and ok["timestamp"] == 1704067200000
    assert RD.check_required(df.filter(F.col("_corrupt_record").isNull())).count() == 0


def test_read_rankings_tar_gz(spark, scratch):
    body = b"1,google.com\n2,youtube.com\n3,facebook.com\n"
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        info = tarfile.TarInfo("top-1m.csv")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    path = os.path.join(scratch, "Rank_2017-11-01.tar.gz")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    rows = RD.read_rankings(spark, path).orderBy("rank").collect()
    assert [(r.rank, r.domain) for r in rows] == [(1, "google.com"), (2, "youtube.com"),
                                                  (3, "facebook.com")]
    assert str(rows[0].day) == "2017-11-01"


def test_sinks_round_trip(spark, scratch, fx):
    sets = REC.compact_records(fx.observations)
    out = os.path.join(scratch, "records")
    SK.write_records(sets, out)
    assert any(n.endswith(".json.gz") for n in os.listdir(out))
    back = RD.read_records(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sets.collect()))

    feats = REC.record_features(sets)
    csv = os.path.join(scratch, "feats")
    SK.write_csv(feats, csv, compression="gzip")
    names = feats.columns
    again = RD.read_features(spark, [csv], names)
    assert again.count() == feats.count()

    by_day = os.path.join(scratch, "by_day")
    SK.write_by_day(sets.select("domain", "date", F.size("records").alias("n")), by_day)
    assert any(d.startswith("date=") for d in os.listdir(by_day))

    single = os.path.join(scratch, "single")
    SK.write_single(feats.groupBy("records_count").count(), single)
    assert len([n for n in os.listdir(single) if n.startswith("part-")]) == 1

    counters = os.path.join(scratch, "counters")
    SK.write_counters(feats.groupBy("records_count").count(), counters)
    assert spark.read.json(counters).count() > 0


def test_convert_raw_prunes_falsy(spark, scratch, fx):
    out = os.path.join(scratch, "raw")
    obs = fx.observations.drop("day")
    SK.convert_raw(obs, out)
    back = RD.read_observations(spark, out)
    assert back.count() == obs.count()
    # status_code 0 was dropped, so it reads back as null
    assert back.filter(F.col("status_code").isNull()).count() == obs.filter(F.col("status_code") == 0).count()


def test_rank_aggregate_csv(spark, scratch):
    p = os.path.join(scratch, "agg.csv")
    with open(p, "w") as f:
        f.write("a.com,3,1,5,2.5,1.0,1.0,0.1,-1.2\n")
    r = RD.read_rank_aggregate(spark, p).first()
    assert r.domain == "a.com" and r["count"] == 3 and r.avg_rank == 2.5


def test_list_files_and_audit(spark, scratch):
    for d in ("20240101", "20240102"):
        os.makedirs(os.path.join(scratch, d))
        for i in range(11 if d == "20240101" else 3):
            with open(os.path.join(scratch, d, f"p{i}.json.gz"), "wb") as f:
                f.write(b"x")
    files = RD.list_files(spark, scratch).select(
        F.to_date(F.regexp_extract("path", r"/(\d{8})/", 1), "yyyyMMdd").alias("day"),
        F.col("path").alias("file_name"))
    expected = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "d string") \
                    .select(F.to_date("d").alias("day"))
    got = {str(r.day): (r.present, r.files, r.complete) for r in RD.audit_days(expected, files).collect()}
    assert got == {"2024-01-01": (True, 11, True), "2024-01-02": (True, 3, False),
                   "2024-01-03": (False, 0, False)}


def test_compaction_plan_one_exchange_no_python(spark):
    df = spark.createDataFrame(
        [("www.a.com.", 1704067200000, "A", "a.com.", "10.0.0.1")],
        "query_name string, timestamp long, response_type string, response_name string, ip4_address string")
    from zonelens.schemas import pad_to_observation_schema
    plan = _plan(REC.compact_records(pad_to_observation_schema(df)))
    assert plan.count("Exchange") == 1
    assert "EvalPython" not in plan and "PythonUDF" not in plan


def test_suffix_join_is_equi(spark):
    rules = SUF.rules_table(spark, ["com", "*.uk"])
    df = spark.createDataFrame([("a.b.com",)], "host string")
    plan = _plan(SUF.registrable_domain(df, rules))
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_registered_queries_have_no_python_udfs(spark):
    for name in ("c2_j2_day_features", "d7_txt_label_counts", "j6_name_features",
                 "c3_registrable_domain", "e1_top_n_per_day"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "EvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_top_n_uses_group_limit(spark):
    plan = _plan(QUERIES["e1_top_n_per_day"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in plan


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_days_prunes_partitions(spark, scratch):
    df = spark.range(100).select(
        F.date_add(F.lit("2023-12-20").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    df.write.partitionBy("day").parquet(os.path.join(scratch, "p"))
    r = spark.read.parquet(os.path.join(scratch, "p"))
    out = RD.filter_days(r, ["202401", "20240215", "2023"])
    assert "PartitionFilters: [" in _plan(out) and out.count() == 31 + 1 + 12
    # yyyyMMdd text keys use prefixes
    txt = spark.createDataFrame([("20240101",), ("20231231",), ("20240201",)], "day string")
    assert sorted(x.day for x in RD.filter_days(txt, ["202401", "2023"]).collect()) == ["20231231", "20240101"]


def test_bucketed_compaction_needs_no_shuffle(spark, fx):
    obs = REC.with_keys(fx.observations).drop("event_id", "day")
    SK.write_bucketed(obs, "zl_test_bucketed_obs", 4, ("domain",))
    try:
        out = REC.compact_records(spark.table("zl_test_bucketed_obs"))
        assert "Exchange" not in _plan(out)
        expected = {(r.domain, r.date): r.records for r in REC.compact_records(fx.observations).collect()}
        assert {(r.domain, r.date): r.records for r in out.collect()} == expected
    finally:
        spark.sql("DROP TABLE IF EXISTS zl_test_bucketed_obs")


def test_avro_source_is_gated(spark, scratch):
    import pytest
    try:
        RD.read_observations_avro(spark, scratch)
    except RuntimeError as exc:
        assert "spark-avro" in str(exc)
    else:  # spark-avro present: an empty folder still yields the fixed schema
        pytest.skip("spark-avro is on the classpath")


def _shuffles(df):
    plan = _plan(df)
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_shuffle_budget_of_headline_operators(spark, fx):
    from zonelens.operators import txt as T
    from zonelens.plans import jobs as J
    # aggregates: one hash exchange each; the join adds one for the rankings side
    # (the record sets are already clustered by (domain, date) after their aggregate)
    assert _shuffles(REC.compact_records(fx.observations)) == 1
    assert _shuffles(T.txt_label_counts(fx.observations)) == 1
    assert _shuffles(T.txt_report_counts(fx.observations)) == 1
    rankings = fx.rankings.select("day", "domain", "rank")
    base = _shuffles(rankings)  # the fixture's own ranking window
    # distinct lines, then counts per (domain, date); one exchange for the rankings side
    plan = _plan(J.month_features(fx.rankings, fx.observations))
    assert _shuffles(J.month_features(fx.rankings, fx.observations)) == base + 3
    assert "ObjectHashAggregate" not in plan and "collect_" not in plan


def test_document_entropy_needs_no_shuffle(spark):
    from zonelens.operators.entropy import text_entropy
    assert "Exchange" not in _plan(QUERIES["b11_entropy_documents"](spark, "/root/testdata/sf0.001"))
    df = spark.createDataFrame([(1, "aa"), (1, "bb"), (2, "ab"), (3, ""), (4, None), (5, "é漢" * 4)], "k int, t string")
    assert sorted(((r.k, r.entropy) for r in text_entropy(df, "k", "t").collect()), key=str) == [
        (1, 0.0), (1, 0.0), (2, 1.0), (3, 0.0), (4, None), (5, 1.0)]


def test_registered_plans_have_no_round_robin(spark):
    import contextlib
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    try:
        for name in QUERIES:
            assert "RoundRobin" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name
    finally:
        with contextlib.suppress(Exception):
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_read_the_observations_once(spark):
    for name in ("j7_txt_report", "d20_txt_shares_with_other", "d20_query_type_shares"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.split("== Physical Plan ==")[-1].count("events.parquet") <= 2, name  # tree line and details


def test_rollup_keeps_rows_without_a_day(spark):
    from zonelens.operators import txt as T
    df = spark.createDataFrame([(None, "a.b", 2), ("2024-01-01", "a.b", 3)], "day string, label string, n int")
    got = {(r.day, r.label, r.level): r.n for r in T.category_rollup(df).collect()}
    assert got[(None, "a.b", 0)] == 2 and got[(None, None, 3)] == 2 and len(got) == 6


def test_href_forms(spark):
    html = ("<a HREF = '/th 1'>x</a><a href=/than>y</a><a data-href=\"/no\" href=\"/an?x=1\">z</a><a href='/th'>short</a>"
            "<a href=\"/t.hx\">dot</a>")
    df = spark.createDataFrame([(html,)], "html string")
    assert [r.link for r in RD.extract_links(df, "/", ["th", "an"]).collect()] == ["/th 1", "/than", "/an?x=1"]
    assert [r.link for r in RD.extract_links(df, "/t.").collect()] == ["/t.hx"]
    assert RD.extract_links(spark.createDataFrame([(None,)], "html string"), "/").count() == 0


def test_cli_jobs_on_files(spark, scratch):
    from zonelens import cli
    raw = os.path.join(scratch, "raw", "20171101")
    os.makedirs(raw)
    day = 1509494400000
    rows = [{"query_type": "TXT", "query_name": "www.a.com.", "response_type": "TXT",
             "response_name": "a.com.", "timestamp": day + i, "worker_id": 1,
             "status_code": 0, "txt_text": "v=spf1 -all" if i else "my password"} for i in range(3)]
    rows.append({"query_type": "SOA", "query_name": "a.com.", "response_type": "SOA",
                 "response_name": "a.com.", "timestamp": day, "worker_id": 1,
                 "status_code": 0, "soa_refresh": 86400, "soa_retry": 7200})
    rows.append({"query_type": "A", "query_name": "b.com.", "response_type": "A", "response_name": "b.com.",
                 "timestamp": day + 86400_000, "worker_id": 1, "status_code": 0, "ip4_address": "1.2.3.4"})
    with gzip.open(os.path.join(raw, "p.json.gz"), "wt") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    for d, text in (("2017-11-01", "1,a.com\n2,b.com\nn/a,c.com\nno-comma\n"), ("2017-11-02", "1,b.com\n2,a.com\n")):
        with open(os.path.join(scratch, f"Rank_{d}.csv"), "w") as f:
            f.write(text)
    ranks = os.path.join(scratch, "Rank_*.csv")
    src = ["--obs", raw]
    both = ["--rankings", ranks, *src]

    def job(name, *args):
        out = os.path.join(scratch, "out-" + name)
        return out, cli.run(spark, [name, *args, "--out", out])

    def rejected(out):
        return {(r.source, r.reason): r.n for r in spark.read.json(out + ".rejected").collect() if r.n}

    malformed = {("observations", "malformed line"): 1}
    bad_ranks = {("rankings", "not two fields"): 1, ("rankings", "rank is no number"): 1}
    out, got = job("compact", *src)
    assert {r.domain: r.records for r in got.collect()}["b.com"] == ["@ A 1.2.3.4"] and rejected(out) == malformed
    out, got = job("grouped", *src, "--day", "20171101")
    assert [sum(x.n for x in r.records) for r in got.collect()] == [4]
    out, got = job("convert", *src)
    assert spark.read.json(out).count() == 5 and rejected(out) == malformed
    out, got = job("features", *both, "--day", "20171101")
    assert [(r.domain, r.date, r.alexa_rank, r.TXT, r.SOA) for r in spark.read.parquet(out).collect()] == [("a.com", "20171101", 1, 2, 1)]
    assert rejected(out) == malformed | bad_ranks
    assert [(r.line, r.reasons) for r in spark.read.json(out + ".quarantine").collect()] == [("{broken", ["malformed line"])]
    out, got = job("correlation", *both)
    assert got.count() == 2 * 105
    out, got = job("rank-stats", "--rankings", ranks)
    stats = ["--stats", out]
    assert {r.domain: r["count"] for r in got.collect()} == {"a.com": 2, "b.com": 2, "c.com": 0} and rejected(out) == bad_ranks
    out, got = job("top", "--rankings", ranks, "--n", "1")
    assert sorted((r.date, r.domain) for r in got.collect()) == [("20171101", "a.com"), ("20171102", "b.com")]
    assert job("names", *stats)[1].count() == 2 and job("entropy", *stats)[1].count() == 3
    assert [(r.length, r.len_count) for r in job("lengths", *stats)[1].collect()] == [(5, 3)]
    assert sorted(map(tuple, job("length-rank", *stats)[1].collect())) == [(5, 1), (5, 1)]
    assert job("random-names", *stats)[1].count() == 8
    out, got = job("txt", *src, "--day", "20171101", "--csv")
    counts = {(x.section, x.label): x.n for x in got.collect()}
    assert counts[("basic", "txt")] == 3 and counts[("specific", "mail-security.spf")] == 2 and counts[("sensitive", "sensitive")] == 1
    assert [r._c1 for r in spark.read.csv(out + ".sensitive").collect()] == ["my password"] and rejected(out) == malformed
    soa = job("soa", *src)[1].collect()
    assert {(r.in_range_refresh, r.in_range_retry) for r in soa} == {(1, 1), (0, 0)}
    assert {r.query_type for r in job("qtypes", *src, "--day", "20171102")[1].collect()} == {"A"}
    rules, names = os.path.join(scratch, "rules.dat"), os.path.join(scratch, "names.txt")
    with open(rules, "w") as f:
        f.write("// public suffixes\n\ncom\nco.uk  comment\n")
    with open(names, "w") as f:
        f.write("b.com\nb.com\nelsewhere.org\n")
    assert {r.registrable_domain: r.n for r in job("registrable", *src, "--rules", rules)[1].where("line LIKE '% A %'").collect()} == {"b.com": 1}
    assert sorted(map(tuple, job("trajectories", "--rankings", ranks, "--names", names)[1].collect())) == [("b.com", 1, "20171102"), ("b.com", 2, "20171101")]
    assert {(r.month, r.TXT, r.A) for r in job("qtype-months", *src)[1].collect()} == {("2017-11", 3, 1)}
    assert {(r.month, r["mail-security"]) for r in job("txt-months", *src)[1].collect()} == {("2017-11", 2)}
    assert {(r.label, r.n) for r in job("txt-shares", *src)[1].collect()} == {("mail-security", 2), ("other", 1)}
    assert job("random-samples", *stats, "--n", "2")[1].count() >= 0
    audit = {str(r.day): (r.files, r.complete) for r in job("audit", "--obs", os.path.dirname(raw), "--rankings", ranks, "--files", "1")[1].collect()}
    assert audit == {"2017-11-01": (1, True), "2017-11-02": (0, False)}


def test_entry_and_soa_report_cover_every_day(spark, fx):
    got = entry.entry(spark).groupBy("date").count().collect()
    joined = QUERIES["j1_month_features"](spark, "/root/testdata/sf0.001").groupBy("date").count().collect()
    assert len(got) > 6 and sorted(map(tuple, got)) == sorted(map(tuple, joined))
    days = {r[0] for r in fx.observations.select("day").distinct().collect()}
    report = QUERIES["j8_all_days_soa_report"](spark, "/root/testdata/sf0.001").collect()
    assert len(report) == len(days) > 6 and {r["day"] for r in report} == days
