"""Registered queries: one per operator id of the inventory, each with a
DuckDB oracle where the operator is SQL-expressible.

Every query reads the driver tables through the adapter views (whole
tables, no row caps); a ``limit`` appears only where it is the feature
(top-k heads, previews).  Doubles that come out of floating-point
aggregates are rounded to 6 decimals on both sides so that the value hash
does not depend on summation order.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.functions import names as N
from zonelens.functions import records as RF
from zonelens.functions import txt as TF
from zonelens.operators import querytypes as QT
from zonelens.operators.entropy import text_entropy
from zonelens.operators import rankings as R
from zonelens.operators import records as REC
from zonelens.operators import stats as S
from zonelens.operators import suffix as SUF
from zonelens.operators import txt as T
from zonelens.operators.soa import soa_ranges
from zonelens.plans import jobs as J
from zonelens.plans.bindings import Fixture
from zonelens.plans.oracle_sql import (NAME_PARTS, OBS_KEYED, OBS_LINES, OWNER, RANK_STATS,
                                       TXT_CLEAN, entropy_cte, oracle, txt_labels_sql)
from zonelens.sources import readers as RD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROUND = 6
# The days that the day-wise queries select.
SOME_DAYS = [_dt.date(2024, 1, d) for d in (3, 4, 5, 11, 17, 30)]
SOME_DAYS_SQL = ", ".join(f"DATE '{d}'" for d in SOME_DAYS)
# Domains whose trajectories are drawn.
TRAJECTORY_DOMAINS = ["therat.example.net", "m.ththth.example.net", "ads-track.example.org",
                      "thering.example.com"]


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def dround(x: str, digits: int = ROUND) -> str:
    """DuckDB counterpart of ``rnd``: rounded, with -0.0 printed as 0.0."""
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END)"


def rnd(c, digits: int = ROUND):
    """Round for the value hash; -0.0 is printed as 0.0 in both engines."""
    r = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def _fx(spark, sf_dir) -> Fixture:
    """One Fixture (lazy logical plans, no cached data) per application and
    folder, so the adapter SQL is parsed and analysed once, not per query."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, sf_dir)
    return _FIXTURES[key]


def _names(fx: Fixture) -> DataFrame:
    """Distinct ranked domains, names from the words of documents, and the
    literal edge-case hosts."""
    return (fx.rankings.select("domain").distinct().unionByName(fx.doc_names)
              .unionByName(fx.extra_hosts.select(F.col("host").alias("domain"))))


NAMES_SQL = ("SELECT DISTINCT domain FROM rankings UNION ALL SELECT domain FROM doc_names "
             "UNION ALL SELECT host AS domain FROM extra_hosts")


# --------------------------------------------------------------- A: sources
@q("a2_parse_rank_lines", oracle(
    "SELECT CAST(strptime(replace(substr(regexp_extract(file_name, '[^_]*$'), 1, 10), '-', ''), '%Y%m%d') AS DATE) AS day, "
    "CASE WHEN length(split_part(line, ',', 1)) > 100 THEN 1 "
    "ELSE TRY_CAST(split_part(line, ',', 1) AS INTEGER) END AS rank, split_part(line, ',', 2) AS domain "
    "FROM rank_lines WHERE len(string_split(line, ',')) = 2"))
def a2_parse_rank_lines(spark, sf):
    return RD.parse_rank_lines(_fx(spark, sf).rank_lines)


@q("a3_day_from_file_name", oracle(
    "SELECT DISTINCT file_name, CAST(strptime(replace(substr(regexp_extract(file_name, '[^_]*$'), 1, 10), '-', ''), "
    "'%Y%m%d') AS DATE) AS day FROM rank_lines"))
def a3_day_from_file_name(spark, sf):
    fx = _fx(spark, sf)
    return (fx.rank_lines.select("file_name").distinct()
              .select("file_name", RD.day_from_file_name("file_name").alias("day")))


@q("a6_filter_days", oracle(
    "SELECT day, domain, rank FROM rankings "
    "WHERE strftime(day, '%Y%m%d') LIKE '20240103%' OR strftime(day, '%Y%m%d') LIKE '20240117%' "
    "OR strftime(day, '%Y%m%d') LIKE '2023%'"))
def a6_filter_days(spark, sf):
    fx = _fx(spark, sf)
    return RD.filter_days(fx.rankings, ["20240103", "20240117", "2023"]).select("day", "domain", "rank")


@q("a7_run_days", oracle(
    "SELECT day, count(*) AS total, count_if(response_type = 'TXT') AS txt "
    f"FROM observations WHERE day IN ({SOME_DAYS_SQL}) GROUP BY day"))
def a7_run_days(spark, sf):
    obs = _fx(spark, sf).observations
    return RD.run_days(obs, [d.strftime("%Y%m%d") for d in SOME_DAYS],
                       lambda df: T.txt_basic(df).select("day", "total", "txt"))


@q("a14_audit_days", oracle(
    "SELECT e.day, f.n IS NOT NULL AS present, coalesce(f.n, 0) AS files, coalesce(f.n, 0) = 11 AS complete "
    "FROM (SELECT DISTINCT day FROM hits) e "
    "LEFT JOIN (SELECT day, count(DISTINCT file_name) AS n FROM day_files GROUP BY day) f ON e.day = f.day"))
def a14_audit_days(spark, sf):
    fx = _fx(spark, sf)
    return RD.audit_days(fx.hits.select("day"), fx.day_files)


@q("c4_missing_days", oracle(
    "SELECT DISTINCT day FROM hits WHERE day NOT IN (SELECT day FROM day_files)"))
def c4_missing_days(spark, sf):
    fx = _fx(spark, sf)
    return RD.missing_days(fx.hits.select("day"), fx.day_files)


@q("k6_rejected_rank_lines", oracle(
    "SELECT 'rankings' AS source, reason, n FROM (SELECT "
    "count_if(len(line) - len(replace(line, ',', '')) <> 1) AS \"not two fields\", "
    "count_if(len(line) - len(replace(line, ',', '')) = 1 AND length(split_part(line, ',', 1)) <= 100 "
    "AND TRY_CAST(split_part(line, ',', 1) AS INTEGER) IS NULL) AS \"rank is no number\", "
    "count_if(len(line) - len(replace(line, ',', '')) = 1 AND NOT regexp_matches(file_name, "
    "'_[0-9]{4}-[0-9]{2}-[0-9]{2}[^_]*$')) AS \"no day in the file name\" "
    "FROM rank_lines) UNPIVOT (n FOR reason IN (\"not two fields\", \"rank is no number\", \"no day in the file name\"))"))
def k6_rejected_rank_lines(spark, sf):
    return RD.rejected_rank_lines(_fx(spark, sf).rank_lines)


@q("a15_extract_links", oracle(
    "SELECT link FROM (SELECT CASE WHEN rest[1] IN ('\"', '''') THEN split_part(substr(rest, 2), rest[1], 1) "
    "ELSE regexp_extract(rest, '^[^ >]*') END AS link FROM (SELECT unnest(string_split(html, 'href=')[2:]) AS rest FROM pages)) "
    "WHERE (starts_with(link, '/th') OR starts_with(link, '/an')) AND length(link) > 3"))
def a15_extract_links(spark, sf):
    return RD.extract_links(_fx(spark, sf).pages, "/", ["th", "an"])


# ------------------------------------------------ B: projections and scalars
@q("b1_normalise_domain", oracle(
    "SELECT event_id, query_name, domain FROM obs_k", obs_k=OBS_KEYED))
def b1_normalise_domain(spark, sf):
    obs = _fx(spark, sf).observations
    return obs.select("event_id", "query_name", N.normalise_domain("query_name").alias("domain"))


@q("b2_day_key", oracle("SELECT event_id, date FROM obs_k", obs_k=OBS_KEYED))
def b2_day_key(spark, sf):
    obs = _fx(spark, sf).observations
    return obs.select("event_id", N.day_key("timestamp").alias("date"))


@q("b3_relative_owner", oracle(
    f"SELECT event_id, {OWNER} AS owner FROM obs_k WHERE response_name IS NOT NULL", obs_k=OBS_KEYED))
def b3_relative_owner(spark, sf):
    obs = REC.with_keys(_fx(spark, sf).observations).filter(F.col("response_name").isNotNull())
    return obs.select("event_id", N.relative_owner("response_name", "domain").alias("owner"))


@q("b4_record_line", oracle("SELECT event_id, line FROM obs_l", obs_k=OBS_KEYED, obs_l=OBS_LINES))
def b4_record_line(spark, sf):
    keyed = REC.with_keys(_fx(spark, sf).observations)
    return keyed.select("event_id", RF.record_line("domain").alias("line"))


def _json_field(name: str, kind: str) -> str:
    if kind == "str":
        return f"CASE WHEN {name} <> '' THEN '\"{name}\":' || to_json({name}) END"
    return f"CASE WHEN {name} <> 0 THEN '\"{name}\":' || CAST({name} AS VARCHAR) END"


def _obs_payload_fields():
    """Observation view columns in view order, minus id, day and timestamp."""
    import re

    from zonelens.plans.bindings import OBSERVATIONS_SQL
    cols = re.findall(r"AS (\w+)\s*(?:,|\n)", OBSERVATIONS_SQL)
    return [c for c in cols if c not in ("event_id", "day", "timestamp")]


_INT_FIELDS = {"worker_id", "status_code", "mx_preference", "dnskey_flags", "dnskey_protocol",
               "dnskey_algorithm", "ds_key_tag", "ds_algorithm", "ds_digest_type",
               "rrsig_algorithm", "rrsig_labels", "rrsig_original_ttl", "rrsig_signature_inception",
               "rrsig_signature_expiration", "rrsig_key_tag", "caa_flags", "soa_serial",
               "soa_refresh", "soa_retry", "soa_expire", "soa_minimum"}


def _prune_sql() -> str:
    fields = ["query_type", "query_name", "response_type", "response_name"] + [
        c for c in _obs_payload_fields()
        if c not in ("query_type", "query_name", "response_type", "response_name")]
    parts = ", ".join(_json_field(c, "int" if c in _INT_FIELDS else "str") for c in fields)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


@q("b5_prune_falsy", oracle(
    f"SELECT event_id, {_prune_sql()} AS record FROM observations"))
def b5_prune_falsy(spark, sf):
    obs = _fx(spark, sf).observations
    payload = obs.drop("day", "timestamp")
    return payload.select("event_id", RF.prune_falsy(payload, drop=("event_id",)).alias("record"))


@q("b6_parse_rank", oracle(
    "SELECT line, CASE WHEN length(split_part(line, ',', 1)) > 100 THEN 1 "
    "ELSE TRY_CAST(split_part(line, ',', 1) AS INTEGER) END AS rank FROM rank_lines "
    "WHERE len(string_split(line, ',')) = 2"))
def b6_parse_rank(spark, sf):
    lines = _fx(spark, sf).rank_lines
    f = F.split("line", ",")
    return lines.filter(F.size(f) == 2).select(
        "line", RD.parse_rank(F.try_element_at(f, F.lit(1))).alias("rank"))


@q("b7_split_name", oracle(
    "SELECT name, tld, rest FROM parts",
    names=NAMES_SQL, parts=NAME_PARTS.format(src="names")))
def b7_split_name(spark, sf):
    return _names(_fx(spark, sf)).select(N.split_name("domain").alias("p")).select("p.*")


@q("b8_length", oracle(
    "SELECT domain, CAST(length(domain) AS INTEGER) AS length FROM names", names=NAMES_SQL))
def b8_length(spark, sf):
    return _names(_fx(spark, sf)).select("domain", N.name_length("domain").alias("length"))


@q("b9_char_counts", oracle(
    "SELECT name, CAST(len(string_split(rest, '.')) - 1 AS INTEGER) AS dot_count, "
    "CAST(length(regexp_replace(rest, '[^0-9]', '', 'g')) AS INTEGER) AS digit_count, "
    "CAST(length(regexp_replace(rest, '[^aeiou]', '', 'g')) AS INTEGER) AS vowel_count FROM parts",
    names=NAMES_SQL, parts=NAME_PARTS.format(src="names")))
def b9_char_counts(spark, sf):
    p = _names(_fx(spark, sf)).select(N.split_name("domain").alias("p"))
    return p.select(F.col("p.name").alias("name"), N.dot_count("p.rest").alias("dot_count"),
                    N.digit_count("p.rest").alias("digit_count"),
                    N.vowel_count("p.rest").alias("vowel_count"))


@q("b10_length_per_count", oracle(
    "SELECT name, round(CASE WHEN d = 0 THEN 0.0 ELSE length(rest) / d END, 6) AS digit_ratio, "
    "round(CASE WHEN v = 0 THEN 0.0 ELSE length(rest) / v END, 6) AS vowel_ratio FROM "
    "(SELECT *, length(regexp_replace(rest, '[^0-9]', '', 'g')) AS d, "
    "length(regexp_replace(rest, '[^aeiou]', '', 'g')) AS v FROM parts)",
    names=NAMES_SQL, parts=NAME_PARTS.format(src="names")))
def b10_length_per_count(spark, sf):
    p = _names(_fx(spark, sf)).select(N.split_name("domain").alias("p"))
    rest = F.col("p.rest")
    n = N.name_length(rest)
    return p.select(F.col("p.name").alias("name"),
                    rnd(N.length_per_count(n, N.digit_count(rest))).alias("digit_ratio"),
                    rnd(N.length_per_count(n, N.vowel_count(rest))).alias("vowel_ratio"))


@q("b11_entropy", oracle(
    "SELECT p.domain, round(e.entropy, 9) AS entropy FROM parts p JOIN ent e ON e.k = p.domain",
    names=NAMES_SQL.replace("UNION ALL", "UNION"),
    parts=NAME_PARTS.format(src="names"), ent=entropy_cte("parts", "domain", "rest")))
def b11_entropy(spark, sf):
    names = _names(_fx(spark, sf)).distinct()
    return names.select("domain", rnd(N.entropy(N.split_name("domain")["rest"]), 9).alias("entropy"))


@q("b11_entropy_documents", oracle(
    "SELECT k AS doc_id, round(entropy, 9) AS entropy FROM ent",
    ent=entropy_cte("documents", "doc_id", "text")))
def b11_entropy_documents(spark, sf):
    docs = _fx(spark, sf).documents
    ent = text_entropy(docs, "doc_id", "text")
    return ent.select("doc_id", rnd("entropy", 9).alias("entropy"))


@q("b12_entropy_ideal", oracle(
    "SELECT name, round(CASE WHEN length(rest) > 0 THEN ln(length(rest)) / ln(2) END, 9) AS ideal_entropy "
    "FROM parts", names=NAMES_SQL, parts=NAME_PARTS.format(src="names")))
def b12_entropy_ideal(spark, sf):
    p = _names(_fx(spark, sf)).select(N.split_name("domain").alias("p"))
    return p.select(F.col("p.name").alias("name"),
                    rnd(N.entropy_ideal(N.name_length("p.rest")), 9).alias("ideal_entropy"))


@q("b13_is_gtld", oracle(
    "SELECT name, CASE WHEN tld IN ('com', 'org', 'net', 'edu', 'gov') THEN 1 ELSE 0 END AS is_gtld "
    "FROM parts", names=NAMES_SQL, parts=NAME_PARTS.format(src="names")))
def b13_is_gtld(spark, sf):
    p = _names(_fx(spark, sf)).select(N.split_name("domain").alias("p"))
    return p.select(F.col("p.name").alias("name"), N.is_gtld("p.tld").alias("is_gtld"))


@q("b14_rank_below", oracle(
    "SELECT domain, CAST(trunc(mean) AS INTEGER) AS avg_ranking FROM st WHERE trunc(mean) < 30",
    st=RANK_STATS))
def b14_rank_below(spark, sf):
    stats = R.rank_stats(_fx(spark, sf).rankings)
    return R.rank_below(stats, 30).select("domain", "avg_ranking")


@q("b15_exclude_idn", oracle(
    "SELECT domain FROM names WHERE NOT regexp_matches(domain, '^xn--')", names=NAMES_SQL))
def b15_exclude_idn(spark, sf):
    return _names(_fx(spark, sf)).filter(N.not_idn("domain"))


@q("b16_exclude_keyword", oracle(
    "SELECT DISTINCT domain FROM rankings WHERE position('blog' IN domain) = 0"))
def b16_exclude_keyword(spark, sf):
    return _fx(spark, sf).rankings.select("domain").distinct().filter(N.without_keyword("domain", "blog"))


@q("b17_clean_txt", oracle(
    f"SELECT event_id, {TXT_CLEAN} AS text FROM observations WHERE response_type = 'TXT'"))
def b17_clean_txt(spark, sf):
    obs = _fx(spark, sf).observations
    return obs.filter(F.col("response_type") == "TXT").select(
        "event_id", TF.clean_txt("txt_text").alias("text"))


@q("b18_record_labels", oracle(
    "SELECT event_id, concat_ws(',', 'dns', CASE WHEN response_type = 'TXT' THEN 'txt' END, "
    f"CASE WHEN response_type = 'TXT' AND coalesce({TXT_CLEAN}, '') <> '' THEN 'correct_txt' END) AS labels "
    "FROM observations"))
def b18_record_labels(spark, sf):
    obs = _fx(spark, sf).observations
    return obs.select("event_id", F.array_join(TF.record_labels(), ",").alias("labels"))


@q("b19_txt_labels", oracle(
    f"SELECT event_id, text, array_to_string({txt_labels_sql('text')}, ',') AS labels FROM "
    f"(SELECT event_id, {TXT_CLEAN} AS text FROM observations WHERE response_type = 'TXT') WHERE text <> ''"))
def b19_txt_labels(spark, sf):
    obs = _fx(spark, sf).observations
    rows = (obs.filter(F.col("response_type") == "TXT")
               .select("event_id", TF.clean_txt("txt_text").alias("text")).filter(F.col("text") != ""))
    return rows.select("event_id", "text", F.array_join(TF.txt_labels("text"), ",").alias("labels"))


@q("b19_txt_labels_documents", oracle(
    f"SELECT doc_id, array_to_string({txt_labels_sql('text')}, ',') AS labels FROM documents"))
def b19_txt_labels_documents(spark, sf):
    docs = _fx(spark, sf).documents
    return docs.select("doc_id", F.array_join(TF.txt_labels("text"), ",").alias("labels"))


@q("b20_sensitive_txt", oracle(
    f"SELECT day, text, name FROM (SELECT day, {TXT_CLEAN} AS text, response_name AS name "
    "FROM observations WHERE response_type = 'TXT') "
    "WHERE text <> '' AND regexp_matches(lower(text), 'login|user|password|pswd|private')"))
def b20_sensitive_txt(spark, sf):
    return T.sensitive_txt(_fx(spark, sf).observations)


@q("b20_sensitive_documents", oracle(
    "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN text || ' Log' || 'In' WHEN 4 THEN 'PassWord ' || text "
    "WHEN 7 THEN 'pass word ' || text ELSE text END AS t FROM documents) "
    "WHERE regexp_matches(lower(t), 'login|user|password|pswd|private')"))
def b20_sensitive_documents(spark, sf):
    docs = _fx(spark, sf).documents.select("doc_id", F.expr(
        "CASE doc_id % 9 WHEN 1 THEN text || ' LogIn' WHEN 4 THEN 'PassWord ' || text "
        "WHEN 7 THEN 'pass word ' || text ELSE text END AS t"))
    return docs.filter(TF.is_sensitive("t")).select("doc_id")


@q("b21_txt_rows", oracle(
    f"SELECT day, text, name FROM (SELECT day, {TXT_CLEAN} AS text, response_name AS name "
    "FROM observations WHERE response_type = 'TXT') WHERE text <> ''"))
def b21_txt_rows(spark, sf):
    return T.txt_rows(_fx(spark, sf).observations)


@q("b22_column_pruning", oracle(
    "SELECT soa_refresh, soa_retry, soa_expire, soa_minimum FROM observations WHERE soa_refresh IS NOT NULL"))
def b22_column_pruning(spark, sf):
    obs = _fx(spark, sf).observations
    return obs.select("soa_refresh", "soa_retry", "soa_expire", "soa_minimum") \
              .filter(F.col("soa_refresh").isNotNull())


@q("b23_in_open_range", oracle(
    "SELECT event_id, soa_retry > 3600 AND soa_retry < 10800 AS in_range FROM observations "
    "WHERE soa_retry IS NOT NULL"))
def b23_in_open_range(spark, sf):
    from zonelens.operators.soa import in_open_range
    obs = _fx(spark, sf).observations.filter(F.col("soa_retry").isNotNull())
    return obs.select("event_id", in_open_range("soa_retry", 3600, 10800).alias("in_range"))


def _b24_strict_sql(t):
    return (f"CAST(count(DISTINCT line) FILTER (WHERE split_part(line, ' ', 2) = '{t}') AS INTEGER) "
            f"AS \"{t}\"")


def _b24_text_sql(t):
    return f"CAST(len(string_split(s, ' {t} ')) - 1 AS INTEGER) AS \"{t}\""


FEATS_STRICT = ("SELECT domain, date, CAST(count(DISTINCT line) AS INTEGER) AS records_count, "
                + ", ".join(_b24_strict_sql(t) for t in RF.COUNTED_TYPES)
                + " FROM obs_l GROUP BY domain, date")

SETS_SQL = ("SELECT domain, date, coalesce(list(line ORDER BY split_part(line, ' ', 2), line) "
            "FILTER (WHERE line IS NOT NULL), []::VARCHAR[]) AS records "
            "FROM (SELECT DISTINCT domain, date, line FROM obs_l) GROUP BY domain, date")


@q("b24_type_counts_strict", oracle(
    "SELECT * FROM feats", obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT))
def b24_type_counts_strict(spark, sf):
    return REC.record_counts(_fx(spark, sf).observations)


@q("b24_type_counts_text", oracle(
    "SELECT domain, date, CAST(len(records) AS INTEGER) AS records_count, "
    + ", ".join(_b24_text_sql(t) for t in RF.COUNTED_TYPES)
    + " FROM (SELECT *, array_to_string(records, ';') AS s FROM sets)",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def b24_type_counts_text(spark, sf):
    return REC.record_counts(_fx(spark, sf).observations, "text")


@q("b25_composite_key", oracle(
    "SELECT domain, date, count(*) AS n FROM obs_k GROUP BY domain, date", obs_k=OBS_KEYED))
def b25_composite_key(spark, sf):
    return REC.with_keys(_fx(spark, sf).observations).groupBy("domain", "date") \
              .agg(F.count(F.lit(1)).alias("n"))


@q("b28_to_day", oracle(
    "SELECT DISTINCT date, CAST(strptime(date, '%Y%m%d') AS DATE) AS day FROM obs_k", obs_k=OBS_KEYED))
def b28_to_day(spark, sf):
    keyed = REC.with_keys(_fx(spark, sf).observations).select("date").distinct()
    return keyed.select("date", N.to_day("date").alias("day"))


@q("b29_short_line", oracle(
    "SELECT event_id, CASE WHEN response_type IS NULL OR response_type = '' THEN 'Unknown response type' "
    "ELSE concat_ws(' ', coalesce(response_name, 'None'), response_type, coalesce(CASE response_type "
    "WHEN 'A' THEN ip4_address WHEN 'AAAA' THEN ip6_address WHEN 'CNAME' THEN cname_name "
    "ELSE response_name END, 'None')) END AS line FROM observations"))
def b29_short_line(spark, sf):
    return _fx(spark, sf).observations.select("event_id", RF.short_line().alias("line"))


@q("b30_txt_shares", oracle(
    "SELECT day, round(count_if(response_type = 'TXT') / count(*), 6) AS txt_share, "
    f"count_if(response_type = 'TXT') - count_if(response_type = 'TXT' AND coalesce({TXT_CLEAN}, '') <> '') "
    "AS empty_txt FROM observations GROUP BY day"))
def b30_txt_shares(spark, sf):
    b = T.with_txt_shares(T.txt_basic(_fx(spark, sf).observations))
    return b.select("day", rnd("txt_share").alias("txt_share"), "empty_txt")


@q("b31_trajectory", oracle(
    "SELECT domain, rank AS alexa_rank, strftime(day, '%Y%m%d') AS date FROM rankings "
    "WHERE domain IN ('therat.example.net', 'm.ththth.example.net', 'ads-track.example.org', "
    "'thering.example.com')"))
def b31_trajectory(spark, sf):
    top = _fx(spark, sf).rankings.select(
        "domain", F.col("rank").alias("alexa_rank"), F.date_format("day", "yyyyMMdd").alias("date"))
    return R.trajectory(top, TRAJECTORY_DOMAINS)


@q("b32_normalise_host", oracle(
    "SELECT host, h AS norm, coalesce(len(string_split(h, '.')) = 4 AND "
    "list_bool_and(list_transform(string_split(h, '.'), lambda p: regexp_full_match(p, '[0-9]+') "
    "AND TRY_CAST(p AS BIGINT) <= 255)), false) AS is_ipv4 FROM "
    "(SELECT host, lower(split_part(trim(regexp_replace(trim(host, ' '), '^\\.+|\\.+$', '', 'g'), ' '), ' ', 1)) AS h "
    "FROM (SELECT DISTINCT host FROM hits UNION ALL SELECT host FROM extra_hosts))"))
def b32_normalise_host(spark, sf):
    fx = _fx(spark, sf)
    hosts = fx.hits.select("host").distinct().unionByName(fx.extra_hosts)
    return hosts.select("host", N.normalise_host("host").alias("norm")) \
                .withColumn("is_ipv4", F.coalesce(N.is_ipv4("norm"), F.lit(False)))


# ------------------------------------------------------------------ C: joins
RULES_SQL_NOTE = "suffix_rules"

# registrable domain by a theta match of every rule against every host
C3_SQL = r"""
SELECT h.host, h.h AS norm,
  CASE WHEN regexp_full_match(h.h, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
            AND list_bool_and(list_transform(string_split(h.h, '.'), lambda p: CAST(p AS BIGINT) <= 255))
       THEN h.h
       ELSE (SELECT CASE WHEN m.ps_len < len(string_split(h.h, '.'))
                         THEN array_to_string(string_split(h.h, '.')[len(string_split(h.h, '.')) - m.ps_len:], '.')
                    END
             FROM (SELECT max_by(ps_len, exc * 1000 + ps_len) AS ps_len FROM (
                     SELECT 0 AS exc, len(string_split(rule, '.')) AS ps_len FROM suffix_rules
                     WHERE rule NOT LIKE '!%' AND rule NOT LIKE '*.%'
                       AND (h.h = rule OR h.h LIKE '%.' || rule)
                     UNION ALL
                     SELECT 0, len(string_split(rule, '.')) FROM suffix_rules
                     WHERE rule LIKE '*.%' AND h.h LIKE '%_.' || substr(rule, 3)
                       AND len(string_split(h.h, '.')) >= len(string_split(rule, '.'))
                     UNION ALL
                     SELECT 1, len(string_split(rule, '.')) - 1 FROM suffix_rules
                     WHERE rule LIKE '!%' AND (h.h = substr(rule, 2) OR h.h LIKE '%.' || substr(rule, 2)))) m)
  END AS registrable_domain
FROM (SELECT host, lower(split_part(trim(regexp_replace(trim(host, ' '), '^\.+|\.+$', '', 'g'), ' '), ' ', 1)) AS h
      FROM ({src})) h
"""


@q("c3_registrable_domain", oracle(C3_SQL.replace(
    "{src}", "SELECT DISTINCT host FROM hits UNION ALL SELECT host FROM extra_hosts")))
def c3_registrable_domain(spark, sf):
    fx = _fx(spark, sf)
    hosts = fx.hits.select("host").distinct().unionByName(fx.extra_hosts)
    out = SUF.registrable_domain(hosts, fx.suffix_rules, col="host")
    return out.select("host", N.normalise_host("host").alias("norm"), "registrable_domain")


@q("c1_join_rank_records", oracle(
    "SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, "
    "CAST(len(s.records) AS INTEGER) AS records_count FROM rankings r JOIN sets s "
    "ON s.domain = r.domain AND s.date = strftime(r.day, '%Y%m%d')",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def c1_join_rank_records(spark, sf):
    fx = _fx(spark, sf)
    counts = REC.record_counts(fx.observations).select("domain", "date", "records_count")
    return REC.join_rank_records(REC.rankings_by_date(fx.rankings), counts)


J1_SQL = oracle(
    "SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, f.* EXCLUDE (domain, date) "
    "FROM rankings r JOIN feats f ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d')",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT)


@q("j1_month_features", J1_SQL)
def j1_month_features(spark, sf):
    fx = _fx(spark, sf)
    return J.month_features(fx.rankings, fx.observations)


@q("c2_j2_day_features", oracle(
    "SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, f.* EXCLUDE (domain, date) "
    "FROM rankings r JOIN feats f ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d') "
    f"WHERE r.day IN ({SOME_DAYS_SQL})", obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT))
def c2_j2_day_features(spark, sf):
    fx = _fx(spark, sf)
    return J.day_features(fx.rankings, fx.observations, days=SOME_DAYS)


@q("c2_j2_all_day_features", J1_SQL)
def c2_j2_all_day_features(spark, sf):
    """J2 over every day of the input: ``date`` is the key, no day is selected."""
    fx = _fx(spark, sf)
    return J.day_features(fx.rankings, fx.observations)


@q("j1_month_features_text", oracle(
    "SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, "
    "CAST(len(records) AS INTEGER) AS records_count, "
    + ", ".join(_b24_text_sql(t) for t in RF.COUNTED_TYPES)
    + " FROM rankings r JOIN (SELECT *, array_to_string(records, ';') AS s FROM sets) f "
      "ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d')",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def j1_month_features_text(spark, sf):
    fx = _fx(spark, sf)
    return J.month_features(fx.rankings, fx.observations, mode="text")


# ----------------------------------------------------------- D: aggregations
@q("d1_compact_records", oracle(
    "SELECT domain, date, CAST(len(records) AS INTEGER) AS n_records, "
    "array_to_string(records, ';') AS records FROM sets",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, sets=SETS_SQL))
def d1_compact_records(spark, sf):
    sets = REC.compact_records(_fx(spark, sf).observations)
    return sets.select("domain", "date", F.size("records").alias("n_records"),
                       F.array_join("records", ";").alias("records"))


@q("d1_record_lines", oracle(
    "SELECT DISTINCT domain, date, CASE WHEN line IS NOT NULL THEN split_part(line, ' ', 2) END AS type, line FROM obs_l",
    obs_k=OBS_KEYED, obs_l=OBS_LINES))
def d1_record_lines(spark, sf):
    return REC.record_lines(_fx(spark, sf).observations)


D3_LIST_SQL = ("SELECT domain, date, to_json(list({'record': record, 'n': n} ORDER BY record)) AS records FROM g "
               "GROUP BY domain, date")


@q("d3_group_records_nested", oracle(
    D3_LIST_SQL, obs_k=OBS_KEYED,
    g=f"SELECT domain, date, record, count(*) AS n FROM (SELECT domain, date, {_prune_sql()} AS record FROM obs_k) "
      "GROUP BY domain, date, record"))
def d3_group_records_nested(spark, sf):
    obs = _fx(spark, sf).observations.drop("event_id", "day")
    return REC.group_records(obs, nested=True).select("domain", "date", F.to_json("records").alias("records"))


@q("d3_group_records", oracle(
    f"SELECT domain, date, record, count(*) AS n FROM (SELECT domain, date, {_prune_sql()} AS record "
    "FROM obs_k) GROUP BY domain, date, record", obs_k=OBS_KEYED))
def d3_group_records(spark, sf):
    obs = _fx(spark, sf).observations.drop("event_id", "day")
    return REC.group_records(obs, nested=False)


D4_SQL = oracle(
    "SELECT st.domain, st.n AS count, st.mn AS min_rank, st.mx AS max_rank, "
    f"{dround('st.mean')} AS avg_rank, "
    f"{dround('CASE WHEN st.n > 1 THEN sqrt(c.m2 / (st.n - 1)) END')} AS stddev_rank, "
    f"{dround('CASE WHEN st.n > 1 THEN c.m2 / (st.n - 1) END')} AS variance_rank, "
    f"{dround('CASE WHEN c.m2 <> 0 THEN sqrt(st.n) * c.m3 / pow(c.m2, 1.5) END')} AS skewness_rank, "
    f"{dround('CASE WHEN c.m2 <> 0 THEN st.n * c.m4 / (c.m2 * c.m2) - 3 END')} AS kurtosis_rank "
    "FROM st JOIN c ON c.domain = st.domain",
    st=RANK_STATS,
    c="SELECT r.domain, sum((r.rank - s.mean) * (r.rank - s.mean)) AS m2, "
      "sum((r.rank - s.mean) * (r.rank - s.mean) * (r.rank - s.mean)) AS m3, "
      "sum((r.rank - s.mean) * (r.rank - s.mean) * (r.rank - s.mean) * (r.rank - s.mean)) AS m4 "
      "FROM rankings r JOIN st s ON s.domain = r.domain GROUP BY r.domain")


def _round_doubles(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


@q("d4_rank_stats", D4_SQL)
def d4_rank_stats(spark, sf):
    return _round_doubles(R.rank_stats(_fx(spark, sf).rankings))


@q("d5_length_histogram", oracle(
    "SELECT CAST(length(domain) AS INTEGER) AS length, count(domain) AS len_count "
    "FROM (SELECT DISTINCT domain FROM rankings) GROUP BY 1"))
def d5_length_histogram(spark, sf):
    return R.length_histogram(R.rank_stats(_fx(spark, sf).rankings))


@q("d6_txt_basic", oracle(
    "SELECT day, count(*) AS total, count_if(response_type = 'TXT') AS txt, "
    f"count_if(response_type = 'TXT' AND coalesce({TXT_CLEAN}, '') <> '') AS correct_txt "
    "FROM observations GROUP BY day"))
def d6_txt_basic(spark, sf):
    return T.txt_basic(_fx(spark, sf).observations)


@q("d6_txt_basic_compat", oracle(
    "SELECT day, count(*) AS total, count_if(response_type = 'TXT') AS txt, "
    "count_if(response_type = 'TXT' AND (txt_text IS NULL OR "
    f"{TXT_CLEAN} <> '')) AS correct_txt FROM observations GROUP BY day"))
def d6_txt_basic_compat(spark, sf):
    return T.txt_basic(_fx(spark, sf).observations, compat=True)


TXT_ROWS_SQL = (f"SELECT day, {TXT_CLEAN} AS text, response_name AS name FROM observations "
                f"WHERE response_type = 'TXT' AND {TXT_CLEAN} <> ''")
LABEL_COUNTS_SQL = (f"SELECT day, unnest({txt_labels_sql('text')}) AS label FROM txt_rows")


@q("d7_txt_label_counts", oracle(
    "SELECT day, label, count(*) AS n FROM lab GROUP BY day, label",
    txt_rows=TXT_ROWS_SQL, lab=LABEL_COUNTS_SQL))
def d7_txt_label_counts(spark, sf):
    return T.txt_label_counts(_fx(spark, sf).observations)


def _soa_sql(compat: bool) -> str:
    from zonelens.operators.soa import COMPAT_PAIRING, SOA_RANGES
    parts = []
    for timer, (lo, hi) in SOA_RANGES.items():
        col = "soa_" + (COMPAT_PAIRING[timer] if compat else timer)
        parts.append(f"count(*) FILTER (WHERE {col} BETWEEN {lo + 1} AND {hi - 1}) AS in_range_{timer}")
        if not compat:
            parts.append(f"count(*) FILTER (WHERE {col} <= {lo}) AS below_{timer}")
            parts.append(f"count(*) FILTER (WHERE {col} >= {hi}) AS above_{timer}")
    return oracle("SELECT day, " + ", ".join(parts) + " FROM observations GROUP BY day")


@q("d8_soa_ranges", _soa_sql(False))
def d8_soa_ranges(spark, sf):
    return soa_ranges(_fx(spark, sf).observations)


@q("d8_soa_ranges_compat", _soa_sql(True))
def d8_soa_ranges_compat(spark, sf):
    return soa_ranges(_fx(spark, sf).observations, compat=True)


@q("d9_query_type_counts", oracle(
    "SELECT day, query_type, count(*) AS count FROM observations GROUP BY ALL"))
def d9_query_type_counts(spark, sf):
    return QT.query_type_counts(_fx(spark, sf).observations)


@q("d10_row_multiplicity", oracle(
    "SELECT * EXCLUDE (event_id, timestamp), count(*) AS count FROM observations GROUP BY ALL"))
def d10_row_multiplicity(spark, sf):
    return QT.row_multiplicity(_fx(spark, sf).observations.drop("event_id", "timestamp"))


@q("d11_day_count_histogram", oracle(
    "SELECT n AS day_count, count(*) AS domain_count FROM "
    "(SELECT domain, count(rank) AS n FROM rankings GROUP BY domain) GROUP BY n"))
def d11_day_count_histogram(spark, sf):
    return R.day_count_histogram(R.rank_stats(_fx(spark, sf).rankings))


ENTROPY_SQL = dict(
    names="SELECT DISTINCT domain FROM rankings",
    parts=NAME_PARTS.format(src="names"),
    ent=entropy_cte("parts", "domain", "rest"),
    j5="SELECT p.name AS domain, e.entropy FROM parts p JOIN ent e ON e.k = p.domain "
       "WHERE NOT starts_with(p.name, 'xn--')")


@q("j5_entropy_table", oracle("SELECT domain, round(entropy, 9) AS entropy FROM j5", **ENTROPY_SQL))
def j5_entropy_table(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings)
    return e.select("domain", rnd("entropy", 9).alias("entropy"))


@q("d12_entropy_histogram", oracle(
    "SELECT round_even(round(entropy, 9) * 100, 0) / 100 AS entropy_rnd, count(domain) AS domain_count "
    "FROM j5 GROUP BY 1", **ENTROPY_SQL))
def d12_entropy_histogram(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return S.entropy_histogram(e)


@q("d13_describe_entropy", oracle(
    "SELECT count(entropy) AS count, round(avg(entropy), 6) AS mean, round(stddev_samp(entropy), 6) AS std, "
    "round(min(entropy), 6) AS min, round(quantile_cont(entropy, 0.25), 6) AS q25, "
    "round(quantile_cont(entropy, 0.5), 6) AS q50, round(quantile_cont(entropy, 0.75), 6) AS q75, "
    "round(max(entropy), 6) AS max FROM (SELECT round(entropy, 9) AS entropy FROM j5)", **ENTROPY_SQL))
def d13_describe_entropy(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return _round_doubles(S.describe_numeric(e, "entropy"))


@q("d13_describe_documents", oracle(
    "SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, "
    "CAST(min(n_chars) AS DOUBLE) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q25, "
    "round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, "
    "CAST(max(n_chars) AS DOUBLE) AS max FROM documents"))
def d13_describe_documents(spark, sf):
    return _round_doubles(S.describe_numeric(_fx(spark, sf).documents, "n_chars"))


@q("d14_column_profile", oracle(
    "SELECT count(*) AS rows, count(domain) AS non_null, count(DISTINCT domain) AS distinct, "
    "min(domain) AS min, max(domain) AS max FROM rankings"))
def d14_column_profile(spark, sf):
    return S.column_profile(_fx(spark, sf).rankings, "domain")


@q("d14_column_profile_documents", oracle(
    "SELECT count(*) AS rows, count(lang) AS non_null, count(DISTINCT lang) AS distinct, "
    "min(lang) AS min, max(lang) AS max FROM documents"))
def d14_column_profile_documents(spark, sf):
    return S.column_profile(_fx(spark, sf).documents, "lang")


FEATURES_SQL = dict(
    st=RANK_STATS,
    names="SELECT domain, mean FROM st WHERE trunc(mean) < 100000",
    parts=NAME_PARTS.format(src="names"),
    ent=entropy_cte("parts", "domain", "rest"),
    j6="SELECT p.domain, CAST(length(p.name) AS INTEGER) AS length, "
       "CAST(len(string_split(p.rest, '.')) - 1 AS INTEGER) AS dot_count, "
       "CASE WHEN length(regexp_replace(p.rest, '[^0-9]', '', 'g')) = 0 THEN 0.0 "
       "ELSE length(p.rest) / length(regexp_replace(p.rest, '[^0-9]', '', 'g')) END AS digit_ratio, "
       "CASE WHEN length(regexp_replace(p.rest, '[^aeiou]', '', 'g')) = 0 THEN 0.0 "
       "ELSE length(p.rest) / length(regexp_replace(p.rest, '[^aeiou]', '', 'g')) END AS vowel_ratio, "
       "e.entropy, CASE WHEN length(p.rest) > 0 THEN ln(length(p.rest)) / ln(2) END AS ideal_entropy, "
       "CASE WHEN p.tld IN ('com', 'org', 'net', 'edu', 'gov') THEN 1 ELSE 0 END AS is_gtld, "
       "CAST(trunc(n.mean) AS INTEGER) AS avg_ranking "
       "FROM parts p JOIN ent e ON e.k = p.domain JOIN names n ON n.domain = p.domain")


@q("j6_name_features", oracle(
    "SELECT domain, length, dot_count, round(digit_ratio, 6) AS digit_ratio, "
    "round(vowel_ratio, 6) AS vowel_ratio, round(entropy, 6) AS entropy, "
    "round(ideal_entropy, 6) AS ideal_entropy, is_gtld, avg_ranking FROM j6 WHERE avg_ranking < 50", **FEATURES_SQL))
def j6_name_features(spark, sf):
    return _round_doubles(J.name_feature_table(_fx(spark, sf).rankings, 50))


def _corr_sql(cols, src, by=None):
    """Pairwise r from the least-squares slopes both ways: sign(b_yx) * sqrt(b_yx * b_xy)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sel = []
    for a, b in pairs:
        x, y = f'CAST("{a}" AS DOUBLE)', f'CAST("{b}" AS DOUBLE)'
        fit = f"regr_sxy({y}, {x}) / sqrt(nullif(regr_sxx({y}, {x}) * regr_syy({y}, {x}), 0))"
        key = f"{by}, " if by else ""
        grp = f" GROUP BY {by}" if by else ""
        sel.append(f"SELECT {key}'{a}' AS a, '{b}' AS b, {dround(fit)} AS r FROM {src}{grp}")
    return " UNION ALL ".join(sel)


NULLABLE_COLUMNS = ("n_chars", "words", "lang_size", "doc_id")
NULLABLE_SQL = ("SELECT CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars, "
                "CASE WHEN doc_id % 7 <> 3 THEN len(string_split(text, ' ')) END AS words, "
                "CASE WHEN lang <> 'en' THEN length(text) END AS lang_size, doc_id FROM documents")


@q("d15_correlation_nulls", oracle(_corr_sql(NULLABLE_COLUMNS, "nullable"), nullable=NULLABLE_SQL))
def d15_correlation_nulls(spark, sf):
    d = _fx(spark, sf).documents.select(
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars"),
        F.expr("CASE WHEN doc_id % 7 <> 3 THEN size(split(text, ' ')) END AS words"),
        F.expr("CASE WHEN lang <> 'en' THEN char_length(text) END AS lang_size"), "doc_id")
    return S.correlation_matrix(d, list(NULLABLE_COLUMNS)).withColumn("r", rnd("r"))


@q("d15_correlation_names", oracle(_corr_sql(list(J.CORR_NAME_COLUMNS), "j6"), **FEATURES_SQL))
def d15_correlation_names(spark, sf):
    feats = J.name_feature_table(_fx(spark, sf).rankings)
    return S.correlation_matrix(feats, list(J.CORR_NAME_COLUMNS)).withColumn("r", rnd("r"))


J2_FEATS = dict(obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT,
                j2="SELECT strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, f.* EXCLUDE (domain, date) "
                   "FROM rankings r JOIN feats f ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d')")


@q("j9_rank_record_correlation", oracle(_corr_sql(list(J.CORR_DAY_COLUMNS), "j2", by="date"), **J2_FEATS))
def j9_rank_record_correlation(spark, sf):
    fx = _fx(spark, sf)
    return J.rank_record_correlation(fx.rankings, fx.observations).withColumn("r", rnd("r"))


def _biserial_sql(flag, col, src):
    """r, t and n from the means of the two groups (rows with both values)."""
    return (f"SELECT {dround('r')} AS r, {dround('r * sqrt((n - 2) / (1 - r * r))')} AS t, n FROM (SELECT n, "
            "(m1 - m0) / nullif(s, 0) * sqrt(n1 * n0 / (n * n)) AS r FROM (SELECT count(*) AS n, "
            f"CAST(count(*) FILTER (WHERE {flag} = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE {flag} = 0) AS DOUBLE) AS n0, "
            f"avg({col}) FILTER (WHERE {flag} = 1) AS m1, avg({col}) FILTER (WHERE {flag} = 0) AS m0, stddev_pop({col}) AS s "
            f"FROM {src} WHERE {flag} IS NOT NULL AND {col} IS NOT NULL))")


@q("d16_point_biserial", oracle(_biserial_sql("is_gtld", "avg_ranking", "flagged"), **FEATURES_SQL,
    flagged="SELECT CASE WHEN length > 20 THEN 1 ELSE 0 END AS is_gtld, CASE WHEN dot_count < 3 THEN avg_ranking END AS avg_ranking FROM j6"))
def d16_point_biserial(spark, sf):
    feats = J.name_feature_table(_fx(spark, sf).rankings).select(
        F.expr("CASE WHEN length > 20 THEN 1 ELSE 0 END AS is_gtld"), F.expr("CASE WHEN dot_count < 3 THEN avg_ranking END AS avg_ranking"))
    return _round_doubles(S.point_biserial(feats, "is_gtld", "avg_ranking").drop("p"))


LABELLED_SQL = ("SELECT CASE WHEN d.doc_id % 11 <> 2 THEN l.quality END AS quality, "
                "CASE WHEN d.doc_id % 6 <> 1 THEN d.n_chars END AS n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")


@q("d16_point_biserial_documents", oracle(_biserial_sql("quality", "n_chars", "labelled"), labelled=LABELLED_SQL))
def d16_point_biserial_documents(spark, sf):
    fx = _fx(spark, sf)
    joined = fx.labels.join(fx.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.expr("CASE WHEN doc_id % 11 <> 2 THEN quality END AS quality"), F.expr("CASE WHEN doc_id % 6 <> 1 THEN n_chars END AS n_chars"))
    return _round_doubles(S.point_biserial(joined, "quality", "n_chars").drop("p"))


SHORT_LINE_SQL = ("CASE WHEN response_type IS NULL OR response_type = '' THEN 'Unknown response type' "
                  "ELSE concat_ws(' ', coalesce(response_name, 'None'), response_type, coalesce(CASE response_type "
                  "WHEN 'A' THEN ip4_address WHEN 'AAAA' THEN ip6_address WHEN 'CNAME' THEN cname_name "
                  "ELSE response_name END, 'None')) END")


@q("d17_group_by_registrable", oracle(
    f"SELECT r.registrable_domain, {SHORT_LINE_SQL} AS line, count(*) AS n "
    "FROM observations o JOIN reg r ON r.host = o.response_name "
    "WHERE r.registrable_domain IS NOT NULL GROUP BY 1, 2",
    reg=C3_SQL.replace("{src}", "SELECT DISTINCT response_name AS host FROM observations "
                                "WHERE response_name IS NOT NULL")))
def d17_group_by_registrable(spark, sf):
    fx = _fx(spark, sf)
    return SUF.group_by_registrable(fx.observations, fx.suffix_rules)


LABELS_ROLLUP = dict(txt_rows=TXT_ROWS_SQL, lab=LABEL_COUNTS_SQL,
                     counts="SELECT day, label, count(*) AS n FROM lab GROUP BY day, label")


@q("d18_category_rollup", oracle(
    "SELECT day, split_part(label, '.', 1) AS category, label, CAST(sum(n) AS BIGINT) AS n, "
    "CAST(grouping_id(split_part(label, '.', 1), label) AS BIGINT) AS level FROM counts "
    "GROUP BY ROLLUP (day, split_part(label, '.', 1), label) HAVING day IS NOT NULL", **LABELS_ROLLUP))
def d18_category_rollup(spark, sf):
    return T.category_rollup(T.txt_label_counts(_fx(spark, sf).observations))


@q("d19_month_pivot", oracle(
    "SELECT strftime(day, '%Y-%m') AS month, "
    + ", ".join(f"count(*) FILTER (WHERE query_type = '{t}') AS \"{t}\"" for t in QT.PLOTTED_QUERY_TYPES)
    + " FROM observations GROUP BY 1"))
def d19_month_pivot(spark, sf):
    counts = QT.query_type_counts(_fx(spark, sf).observations).withColumnRenamed("count", "n")
    out = T.month_pivot(counts, QT.PLOTTED_QUERY_TYPES, label_col="query_type")
    return out.select("month", *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t)
                                 for t in QT.PLOTTED_QUERY_TYPES])


@q("d20_txt_shares_with_other", oracle(
    "SELECT label, n, round(n / (SELECT count(*) FROM txt_rows), 6) AS share FROM ("
    "SELECT split_part(label, '.', 1) AS label, count(*) AS n FROM lab GROUP BY 1 "
    "UNION ALL SELECT 'other', count(*) FROM txt_rows WHERE len(" + txt_labels_sql("text") + ") = 0)",
    txt_rows=TXT_ROWS_SQL, lab=LABEL_COUNTS_SQL))
def d20_txt_shares_with_other(spark, sf):
    return T.txt_shares(_fx(spark, sf).observations).withColumn("share", rnd("share"))


@q("d20_txt_shares_within", oracle(
    "SELECT label, count(*) AS n, round(count(*) / (SELECT count(DISTINCT k) FROM l), 6) AS share FROM l GROUP BY label",
    txt_rows=TXT_ROWS_SQL,
    numbered="SELECT row_number() OVER () AS k, text FROM txt_rows",
    l="SELECT k, label FROM (SELECT k, unnest(" + txt_labels_sql("text") + ") AS label FROM numbered) "
      "WHERE split_part(label, '.', 1) = 'domain-identifiers'"))
def d20_txt_shares_within(spark, sf):
    out = T.txt_shares(_fx(spark, sf).observations, name=lambda x: x, within="domain-identifiers")
    return out.withColumn("share", rnd("share"))


@q("d20_txt_shares_compat", oracle(
    "SELECT label, n, round(n / (SELECT count(*) FROM txt_rows), 6) AS share FROM ("
    "SELECT split_part(label, '.', 1) AS label, count(*) AS n FROM lab GROUP BY 1 "
    "UNION ALL SELECT 'other', (SELECT count(*) FROM txt_rows) - (SELECT count(*) FROM lab))",
    txt_rows=TXT_ROWS_SQL, lab=LABEL_COUNTS_SQL))
def d20_txt_shares_compat(spark, sf):
    return T.txt_shares(_fx(spark, sf).observations, compat=True).withColumn("share", rnd("share"))


@q("d20_query_type_shares", oracle(
    "SELECT label, n, round(n / (SELECT count(*) FROM observations), 6) AS share FROM ("
    "SELECT query_type AS label, count(*) AS n FROM observations "
    "WHERE query_type IN ('SOA', 'MX', 'A', 'CNAME', 'NS', 'TXT') GROUP BY 1 "
    "UNION ALL SELECT 'other', count(*) FROM observations "
    "WHERE query_type NOT IN ('SOA', 'MX', 'A', 'CNAME', 'NS', 'TXT'))"))
def d20_query_type_shares(spark, sf):
    obs = _fx(spark, sf).observations
    return T.value_shares(obs, "query_type", QT.PLOTTED_QUERY_TYPES).withColumn("share", rnd("share"))


@q("d21_max_share", oracle(
    "SELECT round(max(s), 6) AS max_share, arg_max(day, (s, day)) AS max_day FROM "
    "(SELECT day, count_if(response_type = 'TXT') / count(*) AS s FROM observations GROUP BY day)"))
def d21_max_share(spark, sf):
    out = T.max_share(T.txt_basic(_fx(spark, sf).observations))
    return out.withColumn("max_share", rnd("max_share"))


@q("d22_removed_count", oracle(
    "SELECT count_if(starts_with(domain, 'xn--')) AS removed, count(*) AS rows FROM names", names=NAMES_SQL))
def d22_removed_count(spark, sf):
    return J.idn_removed(_names(_fx(spark, sf)))


# ---------------------------------------------------------------- E: windows
E1_SQL = ("SELECT domain, rank AS alexa_rank, CAST(rn AS INTEGER) AS rank, strftime(day, '%Y%m%d') AS date "
          "FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank, domain) AS rn "
          "FROM rankings WHERE NOT contains(domain, 'blog')) WHERE rn <= 10")


@q("e1_top_n_per_day", oracle("SELECT * FROM e1", e1=E1_SQL))
def e1_top_n_per_day(spark, sf):
    return R.top_n_per_day(_fx(spark, sf).rankings, 10, "blog")


@q("e2_first_day_trajectories", oracle(
    "SELECT * FROM e1 WHERE domain IN (SELECT domain FROM e1 WHERE date = (SELECT min(date) FROM e1) "
    "ORDER BY rank, domain LIMIT 5)", e1=E1_SQL))
def e2_first_day_trajectories(spark, sf):
    return R.first_day_trajectories(_fx(spark, sf).rankings, 10, "blog", 5)


# ------------------------------------------------------- F: sorts and heads
@q("f2_top_k", oracle(
    "SELECT domain, avg_ranking, length FROM j6 ORDER BY avg_ranking DESC, domain LIMIT 10",
    **FEATURES_SQL))
def f2_top_k(spark, sf):
    feats = J.name_feature_table(_fx(spark, sf).rankings)
    return S.top_k(feats, "avg_ranking", 10, tie="domain").select("domain", "avg_ranking", "length")


@q("f3_j10_bottom_above", oracle(
    "SELECT domain, round(entropy, 9) AS entropy FROM j5 WHERE round(entropy, 9) > 2.5 "
    "ORDER BY round(entropy, 9), domain LIMIT 20", **ENTROPY_SQL))
def f3_j10_bottom_above(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return J.random_name_heads(e, 2.5, 20)


@q("j10_entropy_bands", oracle(
    "SELECT band, n FROM (SELECT "
    + ", ".join(
        f"count_if({'e >= ' if lc else 'e > '}{lo}{'' if hi is None else (' AND e <= ' if hc else ' AND e < ') + str(hi)}) AS \"{name}\""
        for name, (lo, hi, lc, hc) in J.ENTROPY_BANDS.items())
    + " FROM (SELECT round(entropy, 9) AS e FROM j5)) UNPIVOT (n FOR band IN ("
    + ", ".join(f'"{n}"' for n in J.ENTROPY_BANDS) + "))", **ENTROPY_SQL))
def j10_entropy_bands(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return J.random_name_bands(e)


@q("f4_sample_n", oracle(
    "SELECT domain, round(entropy, 9) AS entropy FROM j5 WHERE round(entropy, 9) > 3.0 "
    "AND round(entropy, 9) < 4.0 ORDER BY md5('7:' || domain), domain LIMIT 10", **ENTROPY_SQL))
def f4_sample_n(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return S.sample_n(S.entropy_band(e, 3.0, 4.0), 10, seed=7, key="domain")


@q("j3_join_preview", oracle(
    "SELECT * FROM j1 ORDER BY domain, date LIMIT 10",
    obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT,
    j1="SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, f.* EXCLUDE (domain, date) "
       "FROM rankings r JOIN feats f ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d')"))
def j3_join_preview(spark, sf):
    fx = _fx(spark, sf)
    return J.join_preview(fx.rankings, fx.observations, 10)


# ------------------------------------------------------------------ J: jobs
@q("j4_length_vs_rank", oracle(
    "SELECT CAST(length(domain) AS INTEGER) AS domain_len, CAST(trunc(mean) AS INTEGER) AS avg_ranking "
    "FROM st WHERE trunc(mean) < 20", st=RANK_STATS))
def j4_length_vs_rank(spark, sf):
    return J.length_vs_rank(_fx(spark, sf).rankings, 20)


@q("j7_txt_report", oracle(
    "SELECT day, 'basic' AS section, 'dns' AS label, count(*) AS n FROM observations GROUP BY day "
    "UNION ALL SELECT day, 'basic', 'txt', count_if(response_type = 'TXT') FROM observations GROUP BY day "
    f"UNION ALL SELECT day, 'basic', 'correct_txt', count_if(response_type = 'TXT' AND coalesce({TXT_CLEAN}, '') <> '') "
    "FROM observations GROUP BY day "
    "UNION ALL SELECT day, 'specific', label, count(*) FROM lab GROUP BY day, label "
    "UNION ALL SELECT day, 'sensitive', 'sensitive', count(*) FROM txt_rows "
    "WHERE regexp_matches(lower(text), 'login|user|password|pswd|private') GROUP BY day",
    txt_rows=TXT_ROWS_SQL, lab=LABEL_COUNTS_SQL))
def j7_txt_report(spark, sf):
    return J.txt_report(_fx(spark, sf).observations)


@q("b26_round2", oracle(
    "SELECT domain, round_even(round(entropy, 9) * 100, 0) / 100 AS entropy_rnd FROM j5", **ENTROPY_SQL))
def b26_round2(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return e.select("domain", N.round2("entropy").alias("entropy_rnd"))


@q("b27_entropy_band", oracle(
    "SELECT domain, round(entropy, 9) AS entropy FROM j5 WHERE round(entropy, 9) >= 3.2 "
    "AND round(entropy, 9) < 3.5", **ENTROPY_SQL))
def b27_entropy_band(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return S.entropy_band(e, 3.2, 3.5, lo_closed=True)


@q("f5_preview", oracle(
    "SELECT domain, alexa_rank, rank, date FROM e1 ORDER BY date, rank LIMIT 10", e1=E1_SQL))
def f5_preview(spark, sf):
    top = R.top_n_per_day(_fx(spark, sf).rankings, 10, "blog")
    return S.preview(top, 10, ["date", "rank"])


@q("f6_full_sort", oracle("SELECT domain, round(entropy, 9) AS entropy FROM j5", **ENTROPY_SQL))
def f6_full_sort(spark, sf):
    e = J.entropy_table(_fx(spark, sf).rankings).withColumn("entropy", rnd("entropy", 9))
    return e.orderBy("entropy", "domain")


@q("f7_rows_at", oracle(
    "SELECT day, domain, rank FROM rankings WHERE domain IN ('therat.example.net', "
    "'m.ththth.example.net', 'ads-track.example.org', 'thering.example.com')"))
def f7_rows_at(spark, sf):
    return S.rows_at(_fx(spark, sf).rankings.select("day", "domain", "rank"), "domain",
                     TRAJECTORY_DOMAINS)


@q("j7_sensitive_rows", oracle(
    "SELECT day, text, name FROM txt_rows WHERE regexp_matches(lower(text), 'login|user|password|pswd|private')",
    txt_rows=TXT_ROWS_SQL))
def j7_sensitive_rows(spark, sf):
    return J.txt_sensitive(_fx(spark, sf).observations)


@q("j8_soa_report", _soa_sql(False).replace("FROM observations GROUP BY day",
                                            f"FROM observations WHERE day IN ({SOME_DAYS_SQL}) GROUP BY day"))
def j8_soa_report(spark, sf):
    return RD.run_days(_fx(spark, sf).observations, [d.strftime("%Y%m%d") for d in SOME_DAYS], J.soa_report)


@q("j8_all_days_soa_report", _soa_sql(False))
def j8_all_days_soa_report(spark, sf):
    """J8 over every day of the input."""
    return J.soa_report(_fx(spark, sf).observations)


@q("j9_some_days", oracle(_corr_sql(list(J.CORR_DAY_COLUMNS), "j2", by="date"), **J2_FEATS | {
    "j2": J2_FEATS["j2"] + f" WHERE r.day IN ({SOME_DAYS_SQL})"}))
def j9_some_days(spark, sf):
    fx = _fx(spark, sf)
    return J.rank_record_correlation(fx.rankings, fx.observations, SOME_DAYS).withColumn("r", rnd("r"))


@q("d19_txt_month_pivot", oracle(
    "SELECT strftime(day, '%Y-%m') AS month, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS \"{c}\""
                for c in ("mail-security", "domain-identifiers", "keys", "signature-services",
                          "alias", "i*m", "malt", "number_pipe_site"))
    + " FROM (SELECT day, split_part(label, '.', 1) AS category, n FROM counts) GROUP BY 1",
    **LABELS_ROLLUP))
def d19_txt_month_pivot(spark, sf):
    cats = ("mail-security", "domain-identifiers", "keys", "signature-services", "alias", "i*m",
            "malt", "number_pipe_site")
    counts = T.txt_label_counts(_fx(spark, sf).observations).withColumn("category", T.category_of("label"))
    out = T.month_pivot(counts, cats, label_col="category")
    return out.select("month", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in cats])


@q("d15_correlation_month_features", oracle(
    _corr_sql(list(J.CORR_MONTH_COLUMNS), "j1"),
    obs_k=OBS_KEYED, obs_l=OBS_LINES, feats=FEATS_STRICT,
    j1="SELECT r.domain, strftime(r.day, '%Y%m%d') AS date, r.rank AS alexa_rank, f.* EXCLUDE (domain, date) "
       "FROM rankings r JOIN feats f ON f.domain = r.domain AND f.date = strftime(r.day, '%Y%m%d')"))
def d15_correlation_month_features(spark, sf):
    fx = _fx(spark, sf)
    feats = J.month_features(fx.rankings, fx.observations)
    return S.correlation_matrix(feats, list(J.CORR_MONTH_COLUMNS)).withColumn("r", rnd("r"))


from zonelens.plans import registry_files  # noqa: E402, F401  (adds the queries that write and read files)
