"""Registered queries that write files and read them again (A1, A4-A13, A16, D2, K6), lists
and orders that files hold (B31, F6), and record sets as ordered parts (D1, D3).

Each query writes into a new work folder below the shared folder and returns what is read
back, so its oracle over the source rows checks writer, layout and reader together.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from zonelens.operators import querytypes as QT
from zonelens.operators import rankings as R
from zonelens.operators import records as REC
from zonelens.operators import stats as S
from zonelens.operators.order import numbered
from zonelens.plans import jobs as J
from zonelens.plans.oracle_sql import OBS_KEYED, OBS_LINES, RANK_STATS, oracle
from zonelens.plans.registry import (D4_SQL, ENTROPY_SQL, J1_SQL, SETS_SQL, _fx, _prune_sql, _round_doubles, q, rnd)
from zonelens.schemas import DAY_FEATURE_COLUMNS, OBSERVATION_DDL, ddl_schema
from zonelens.sources import readers as RD
from zonelens.sources import sinks as SK
from zonelens.session import work_folder

# The days whose job is run a second time.
AGAIN = [_dt.date(2024, 2, d) for d in range(1, 15)]
AGAIN_SQL = "day BETWEEN DATE '2024-02-01' AND DATE '2024-02-14'"


@q("a12_day_layout", oracle(
    "SELECT event_id, query_name, response_type, response_name, day FROM observations "
    f"WHERE strftime(day, '%Y%m') IN ('202401', '202402') AND (response_name IS NOT NULL OR NOT ({AGAIN_SQL}))"))
def a12_day_layout(spark, sf):
    """Observations by day; the first half of February is run again without the answers
    that name nothing; January and February are read back."""
    obs = _fx(spark, sf).observations.select("event_id", "query_name", "response_type", "response_name", "day")
    folder = work_folder(spark, "days")
    SK.write_by_day(obs, folder, col="day")
    SK.rewrite_days(obs.where(F.col("day").isin(AGAIN) & F.col("response_name").isNotNull()), folder, AGAIN)
    return RD.filter_days(RD.read_days(
        spark, folder, "event_id long, query_name string, response_type string, response_name string"), ["202401", "202402"])


@q("d2_bucketed_features", J1_SQL)
def d2_bucketed_features(spark, sf):
    """J1 from two tables bucketed by (domain, date): no exchange after the writes."""
    fx, name = _fx(spark, sf), uuid.uuid4().hex
    SK.write_bucketed(REC.with_keys(fx.observations), f"obs_{name}", 16, ("domain", "date"), path=work_folder(spark, "bucketed-obs"))
    SK.write_bucketed(REC.rankings_by_date(fx.rankings), f"ranks_{name}", 16, ("domain", "date"), path=work_folder(spark, "bucketed-ranks"))
    return REC.join_bucketed(spark.table(f"ranks_{name}"), spark.table(f"obs_{name}"))


# Raw lines: every 23rd is cut short, every 29th lacks its status, every 31st its status and time.
RAW_SQL = ("SELECT event_id, query_type, query_name, response_type, response_name, timestamp, worker_id, status_code, "
           "CASE WHEN event_id % 23 = 0 THEN 'cut' WHEN event_id % 31 = 0 THEN 'two' WHEN event_id % 29 = 0 THEN 'one' ELSE 'good' END AS kind "
           "FROM observations")


def _write_raw(spark, sf) -> str:
    """The observations as gzip JSON lines, some of them damaged."""
    obs = _fx(spark, sf).observations
    kind = F.expr("CASE WHEN event_id % 23 = 0 THEN 'cut' WHEN event_id % 31 = 0 THEN 'two' WHEN event_id % 29 = 0 THEN 'one' ELSE 'good' END")
    fields = [c for c in obs.columns if c in ddl_schema(OBSERVATION_DDL).names]
    changed = {"status_code": F.when(~kind.isin("one", "two"), F.col("status_code")), "timestamp": F.when(kind != "two", F.col("timestamp"))}
    text = F.to_json(F.struct(*[changed.get(c, F.col(c)).alias(c) for c in fields]))
    cut = F.concat(F.lit('{"query_name": "'), F.col("query_name"), F.lit('", '), F.col("event_id").cast("string"))
    folder = work_folder(spark, "raw")
    obs.select(F.when(kind == "cut", cut).otherwise(text).alias("value")).write.option("compression", "gzip").text(folder)
    return folder


@q("a1_ingest_accepted", oracle(
    "SELECT query_type, query_name, response_type, response_name, timestamp, worker_id, status_code, "
    "CAST(make_timestamp(timestamp * 1000) AS DATE) AS day FROM raw WHERE kind = 'good'", raw=RAW_SQL))
def a1_ingest_accepted(spark, sf):
    got = RD.ingest_observations(spark, _write_raw(spark, sf), work_folder(spark, "ingested"))
    return got.accepted.select("query_type", "query_name", "response_type", "response_name", "timestamp", "worker_id", "status_code", "day")


@q("k6_quarantine", oracle(
    "SELECT reasons, count(*) AS lines, CAST(sum(cut_id) AS BIGINT) AS cut_ids FROM (SELECT CASE kind WHEN 'cut' THEN 'malformed line' "
    "WHEN 'one' THEN 'status_code is missing' ELSE 'timestamp is missing,status_code is missing' END AS reasons, "
    "CASE WHEN kind = 'cut' THEN event_id ELSE 0 END AS cut_id FROM raw WHERE kind <> 'good') GROUP BY reasons", raw=RAW_SQL))
def k6_quarantine(spark, sf):
    """The rejected lines themselves: by reasons, with the ids that the cut lines still show."""
    got = RD.ingest_observations(spark, _write_raw(spark, sf), work_folder(spark, "ingested"))
    shown = F.coalesce(F.regexp_extract("line", r'", (\d+)$', 1).try_cast("long"), F.lit(0))
    return got.quarantine.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("lines"), F.sum(shown).alias("cut_ids"))


@q("k6_ingest_counts", oracle(
    "SELECT 'observations' AS source, reason, n FROM (SELECT count_if(kind = 'cut') AS \"malformed line\", 0::BIGINT AS \"query_type is missing\", "
    "0::BIGINT AS \"query_name is missing\", count_if(kind = 'two') AS \"timestamp is missing\", 0::BIGINT AS \"worker_id is missing\", "
    "count_if(kind IN ('one', 'two')) AS \"status_code is missing\" FROM raw) UNPIVOT (n FOR reason IN (\"malformed line\", "
    "\"query_type is missing\", \"query_name is missing\", \"timestamp is missing\", \"worker_id is missing\", \"status_code is missing\"))",
    raw=RAW_SQL))
def k6_ingest_counts(spark, sf):
    return RD.ingest_observations(spark, _write_raw(spark, sf), work_folder(spark, "ingested")).counts


@q("a8_a5_records_files", oracle(
    "SELECT domain, date, array_to_string(records, ';') AS records FROM sets", obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def a8_a5_records_files(spark, sf):
    """Record sets as gzip JSON lines and back."""
    folder = work_folder(spark, "records")
    SK.write_records(REC.compact_records(_fx(spark, sf).observations), folder)
    return RD.read_records(spark, folder).select("domain", "date", F.array_join("records", ";").alias("records"))


@q("a9_a16_feature_files", J1_SQL)
def a9_a16_feature_files(spark, sf):
    """Features as headerless gzip CSV in three folders by month, read back together by name."""
    fx, folder = _fx(spark, sf), work_folder(spark, "features")
    feats = J.day_features(fx.rankings, fx.observations).select("domain", "date", *[c for c in DAY_FEATURE_COLUMNS if c != "domain"])
    parts = [f"{folder}/{k}" for k in range(3)]
    for k, part in enumerate(parts):
        SK.write_csv(feats.where(F.substring("date", 5, 2).cast("int") % 3 == k), part, compression="gzip")
    back = RD.read_features(spark, parts, feats.columns)
    return back.withColumn("date", F.col("date").cast("string"))


@q("a9_a4_rank_aggregate_files", D4_SQL)
def a9_a4_rank_aggregate_files(spark, sf):
    """Rank aggregates as headerless CSV and back by the declared schema."""
    folder, stats = work_folder(spark, "stats"), R.rank_stats(_fx(spark, sf).rankings)
    SK.write_csv(stats, folder)
    back = RD.read_rank_aggregate(spark, folder)
    return _round_doubles(back.select(*[F.col(f"`{a}`").cast(t).alias(b) for a, (b, t) in zip(back.columns, stats.dtypes)]))


@q("a10_single_file", oracle(
    "SELECT CAST(length(domain) AS INTEGER) AS length, count(*) AS len_count, 1 AS files "
    "FROM (SELECT DISTINCT domain FROM rankings) GROUP BY 1"))
def a10_single_file(spark, sf):
    """The length histogram in one CSV file."""
    folder = work_folder(spark, "single")
    SK.write_single(R.length_histogram(R.rank_stats(_fx(spark, sf).rankings)), folder)
    files = RD.list_files(spark, folder, "part-*").count()
    return spark.read.schema("length int, len_count long").csv(folder).withColumn("files", F.lit(files).cast("int"))


@q("a11_counters", oracle("SELECT day, query_type, count(*) AS count FROM observations GROUP BY day, query_type"))
def a11_counters(spark, sf):
    """Query-type counters as JSON lines and back."""
    folder = work_folder(spark, "counters")
    SK.write_counters(QT.query_type_counts(_fx(spark, sf).observations), folder)
    return spark.read.schema("day date, query_type string, count long").json(folder)


@q("a13_converted", oracle(f"SELECT {_prune_sql()} AS record FROM observations"))
def a13_converted(spark, sf):
    """Raw rows without their falsy fields as gzip JSON lines."""
    folder = work_folder(spark, "converted")
    SK.convert_raw(_fx(spark, sf).observations.drop("event_id", "day", "timestamp"), folder)
    return spark.read.text(folder).select(F.col("value").alias("record"))


@q("b31_trajectory_table", oracle(
    "SELECT domain, rank AS alexa_rank, strftime(day, '%Y%m%d') AS date FROM rankings WHERE domain IN "
    "(SELECT domain FROM doc_names UNION ALL SELECT host FROM hits WHERE user_id % 3 = 0)"))
def b31_trajectory_table(spark, sf):
    """Trajectories of the names in a table: every name from the documents' words, and the
    hosts that a third of the users have seen."""
    fx = _fx(spark, sf)
    listed = fx.doc_names.select("domain").unionByName(fx.hits.where("user_id % 3 = 0").select(F.col("host").alias("domain")))
    ranks = fx.rankings.select("domain", F.col("rank").alias("alexa_rank"), F.date_format("day", "yyyyMMdd").alias("date"))
    return R.trajectory(ranks, listed)


@q("f6_sorted_positions", oracle(
    "SELECT row_number() OVER (ORDER BY length(domain) DESC, domain) - 1 AS position, domain, CAST(length(domain) AS INTEGER) AS length FROM doc_names"))
def f6_sorted_positions(spark, sf):
    """Names by falling length with their place in the order, as sorted files hold them."""
    names = _fx(spark, sf).doc_names.select("domain", F.char_length("domain").alias("length")).withColumn("falling", -F.col("length"))
    return numbered(names, "falling", "domain", name="sorted").select("position", "domain", "length")


PARTS = 7  # lines of a part


@q("d1_record_parts", oracle(
    "SELECT domain, date, CAST(part AS BIGINT) AS part, CAST(len(records) AS INTEGER) AS n_records, array_to_string(records, ';') AS records FROM ("
    "SELECT domain, date, p.part, records[p.part * 7 + 1:p.part * 7 + 7] AS records FROM sets, range(0, 100000) AS p(part) "
    "WHERE p.part = 0 OR p.part * 7 < len(records))", obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def d1_record_parts(spark, sf):
    """Record sets as ordered parts of at most seven lines."""
    parts = REC.record_parts(_fx(spark, sf).observations, PARTS)
    return parts.select("domain", "date", "part", F.size("records").alias("n_records"), F.array_join("records", ";").alias("records"))


@q("d3_record_parts", oracle(
    "SELECT domain, date, CAST(k // 7 AS BIGINT) AS part, string_agg(record || ' x' || n, ';' ORDER BY record) AS records FROM ("
    "SELECT *, row_number() OVER (PARTITION BY domain, date ORDER BY record) - 1 AS k FROM g) GROUP BY domain, date, k // 7", obs_k=OBS_KEYED,
    g=f"SELECT domain, date, record, count(*) AS n FROM (SELECT domain, date, {_prune_sql()} AS record FROM obs_k) GROUP BY domain, date, record"))
def d3_record_parts(spark, sf):
    """Grouped objects as ordered parts of at most seven."""
    parts = REC.group_record_parts(_fx(spark, sf).observations.drop("event_id", "day"), PARTS)
    joined = F.transform("records", lambda x: F.concat(x["record"], F.lit(" x"), x["n"].cast("string")))
    return parts.select("domain", "date", "part", F.array_join(joined, ";").alias("records"))


_BANDS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS band, domain, e FROM j5r WHERE e {'>=' if lc else '>'} {lo}" + ("" if hi is None else f" AND e {'<=' if hc else '<'} {hi}")
    for name, (lo, hi, lc, hc) in J.ENTROPY_BANDS.items())


@q("f4_sample_bands", oracle(
    "SELECT band, domain, e AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7:' || domain), domain) AS k "
    f"FROM ({_BANDS_SQL})) WHERE k <= 5", **ENTROPY_SQL, j5r="SELECT domain, round(entropy, 9) AS e FROM j5"))
def f4_sample_bands(spark, sf):
    """Five names of each entropy band in one pass."""
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return S.sample_bands(e, J.ENTROPY_BANDS, 5, seed=7).select("band", "domain", "entropy")
