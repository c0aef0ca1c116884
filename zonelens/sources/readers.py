"""Scans (A1-A7, A14-A16).

All readers declare their schema (no inference pass over 100 TB) and stay
DataFrames, so Catalyst prunes columns and pushes filters to the scan (B22:
an operator that selects three fields reads three fields).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from zonelens.schemas import (OBSERVATION_DDL, RANK_AGGREGATE_DDL, RECORDS_DDL,
                              REQUIRED_FIELDS, ddl_schema)


def read_observations(spark: SparkSession, paths, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """A1: gzip JSON lines of DNS answers with the fixed 101-field schema.

    PERMISSIVE mode: a malformed line becomes a row with only the
    ``_corrupt_record`` text set instead of failing the job.
    """
    schema = ddl_schema(OBSERVATION_DDL).add(StructField(corrupt_col, StringType(), True))
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", corrupt_col).json(paths))


def read_observations_avro(spark: SparkSession, paths) -> DataFrame:
    """A1/A13 source for the original Avro files.

    Needs the ``spark-avro`` package on the classpath (not bundled with
    PySpark); without it this raises a clear error instead of a class-not-
    found trace.  The fixed schema is applied so downstream operators see
    the same columns as from JSON.
    """
    try:
        df = spark.read.format("avro").load(paths)
    except Exception as exc:  # AnalysisException: data source not found
        raise RuntimeError("Avro input needs the spark-avro package on the classpath "
                           "(spark.jars.packages=org.apache.spark:spark-avro_2.13:<version>)") from exc
    schema = ddl_schema(OBSERVATION_DDL)
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def check_required(df: DataFrame) -> DataFrame:
    """Rows violating the declared non-null header fields."""
    cond = F.lit(False)
    for c in REQUIRED_FIELDS:
        cond = cond | F.col(c).isNull()
    return df.filter(cond)


def day_from_file_name(c) -> Column:
    """A3: 10 chars after the last ``_`` of a file name, dashes removed,
    parsed as ``yyyyMMdd`` (null when it is not a date)."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.replace(F.substring(F.substring_index(c, "_", -1), 1, 10), F.lit("-"), F.lit(""))
    return F.try_to_date(raw, "yyyyMMdd")


def parse_rank(c) -> Column:
    """Text longer than 100 chars (tar header glued to line 1) -> 1,
    else the integer; non-numeric -> null (counted, not fatal; K6)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.char_length(c) > 100, F.lit(1)).otherwise(c.try_cast("int"))


def parse_rank_lines(lines: DataFrame, line_col: str = "line",
                     file_col: str = "file_name") -> DataFrame:
    """A2 core: keep lines with exactly two comma fields -> (day, rank, domain).

    ``rank`` is null for a non-numeric rank text; ``rejected_rank_lines`` counts them.
    """
    fields = F.split(F.col(line_col), ",")
    return (lines.filter(F.size(fields) == 2)
                 .select(day_from_file_name(file_col).alias("day"),
                         parse_rank(F.try_element_at(fields, F.lit(1))).alias("rank"),
                         F.try_element_at(fields, F.lit(2)).alias("domain")))


def read_rank_lines(spark: SparkSession, paths) -> DataFrame:
    """The lines of daily ranking lists (plain, gzip or tar.gz text) with their
    file name (``_metadata`` column, no whole-file reads)."""
    raw = spark.read.text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))
    # a tar.gz member may hold several lines glued by whitespace
    return raw.select("file_name", F.explode(F.split(F.trim(F.col("line")), r"\s+")).alias("line"))


def read_rankings(spark: SparkSession, paths) -> DataFrame:
    """A2: daily ranking lists, parsed; the day comes from the file name."""
    return parse_rank_lines(read_rank_lines(spark, paths))


def _reasons(df: DataFrame, source: str, counts: dict[str, Column]) -> DataFrame:
    """(source, reason, n) from one aggregate of conditional counts."""
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(k).alias("reason"), F.col(k).alias("n")) for k in counts])).alias("x")).select("x.*")


def rejected_rank_lines(lines: DataFrame, line_col: str = "line", file_col: str = "file_name") -> DataFrame:
    """K6: how many ranking lines no job can use, by reason."""
    fields = F.split(F.col(line_col), ",")
    two = F.size(fields) == 2
    return _reasons(lines, "rankings", {
        "not two fields": ~two,
        "rank is no number": two & parse_rank(F.try_element_at(fields, F.lit(1))).isNull(),
        "no day in the file name": two & day_from_file_name(file_col).isNull()})


def rejected_observations(obs: DataFrame, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """K6: how many observations are malformed or lack a required field."""
    bad = F.col(corrupt_col).isNotNull()
    return _reasons(obs, "observations", {"malformed line": bad, **{
        f"{c} is missing": ~bad & F.col(c).isNull() for c in REQUIRED_FIELDS}})


class Ingested(NamedTuple):
    """``accepted``: the observations and their ``day``; ``quarantine``: (line, reasons)
    of every rejected line; ``counts``: (source, reason, n), 0 included, and the number of
    lines read and accepted."""

    accepted: DataFrame
    quarantine: DataFrame
    counts: DataFrame
    total: int
    kept: int


def ingest_observations(spark: SparkSession, paths, folder: str, days=None, corrupt_col: str = "_corrupt_record") -> Ingested:
    """A1 and K6 in one pass over the raw lines: accepted rows are written to ``folder`` as
    Parquet by day, rejected lines beside them with their reasons (a malformed line as it
    was, a row that lacks a required field as JSON), and both are counted by ``observe``
    while they are written.  ``days`` (``YYYY[MM[DD]]``) leaves out accepted rows of other
    days; the counts are over all lines.

    A line with several missing fields counts for each of them and is quarantined once."""
    raw = read_observations(spark, paths, corrupt_col)
    payload = [F.col(f"`{c}`") for c in raw.columns if c != corrupt_col]
    bad = F.col(corrupt_col).isNotNull()
    checks = {"malformed line": bad, **{f"{c} is missing": ~bad & F.col(c).isNull() for c in REQUIRED_FIELDS}}
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    metrics = Observation()
    seen = raw.observe(metrics, *[F.count_if(cond).alias(name) for name, cond in checks.items()], F.count(F.lit(1)).alias("total"))
    rows = seen.withColumn("reasons", reasons).withColumn("rejected", F.size("reasons") > 0)
    if days:
        kept = F.lit(False)
        for p in days:
            lo, hi = _millis(str(p))
            kept = kept | ((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
        rows = rows.where(F.col("rejected") | kept)
    day = F.when(~F.col("rejected"), F.to_date(F.timestamp_millis("timestamp")))
    line = F.when(F.col("rejected"), F.coalesce(F.col(corrupt_col), F.to_json(F.struct(*payload))))
    out = rows.select(*payload, line.alias("line"), F.when(F.col("rejected"), F.col("reasons")).alias("reasons"), "rejected", day.alias("day"))
    out.write.partitionBy("rejected", "day").parquet(folder)
    found = metrics.get
    names = [f.name for f in raw.schema.fields if f.name != corrupt_col]
    schema = out.schema
    back = spark.read.schema(schema).parquet(folder)
    counts = spark.createDataFrame([("observations", name, found[name]) for name in checks], "source string, reason string, n long")
    accepted = back.where(~F.col("rejected")).select(*[F.col(f"`{c}`") for c in names], "day")
    quarantine = back.where("rejected").select("line", "reasons")
    return Ingested(accepted, quarantine, counts, found["total"], accepted.count() if days else found["total"] - quarantine.count())


def read_rank_aggregate(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    """A4: rank aggregates (headerless CSV by schema, or Parquet)."""
    if fmt == "parquet":
        return spark.read.parquet(paths)
    return spark.read.schema(ddl_schema(RANK_AGGREGATE_DDL)).csv(paths, header=False)


def read_records(spark: SparkSession, paths) -> DataFrame:
    """A5: compact record sets (JSON lines: domain, date, records)."""
    return spark.read.schema(ddl_schema(RECORDS_DDL)).json(paths)


def read_features(spark: SparkSession, paths, names, types: str = "int") -> DataFrame:
    """Many headerless CSV parts, one implicit union, named columns.

    ``types`` gives the type of every column but the first (a string key).
    """
    ddl = ", ".join(f"`{n}` {'string' if i == 0 else types}" for i, n in enumerate(names))
    return spark.read.schema(ddl).csv(paths, header=False)


def _prefix_range(p: str):
    """``YYYY[MM[DD]]`` -> [first day, first day after) as dates."""
    import datetime as _dt
    y = int(p[0:4])
    if len(p) == 4:
        return _dt.date(y, 1, 1), _dt.date(y + 1, 1, 1)
    m = int(p[4:6])
    if len(p) == 6:
        return _dt.date(y, m, 1), (_dt.date(y + 1, 1, 1) if m == 12 else _dt.date(y, m + 1, 1))
    d = _dt.date(y, m, int(p[6:8]))
    return d, d + _dt.timedelta(days=1)


def filter_days(df: DataFrame, prefixes, col: str = "day") -> DataFrame:
    """Keep days matching any ``YYYY[MM[DD]]`` prefix (K20: OR of all).

    On a DATE column each prefix becomes a range ``lo <= day < hi``, which
    Parquet filter pushdown and partition pruning understand; on a
    ``yyyyMMdd`` text partition column it is ``startswith`` (pruned too).
    """
    c = F.col(col)
    is_date = dict(df.dtypes).get(col) == "date"
    cond = F.lit(False)
    for p in prefixes:
        p = str(p)
        if is_date:
            lo, hi = _prefix_range(p)
            cond = cond | ((c >= F.lit(lo)) & (c < F.lit(hi)))
        else:
            cond = cond | c.startswith(p)
    return df.filter(cond)


def _millis(prefix: str) -> tuple[int, int]:
    """``YYYY[MM[DD]]`` -> [first, first after) in epoch milliseconds."""
    import datetime as _dt
    return tuple(int(_dt.datetime(d.year, d.month, d.day, tzinfo=_dt.timezone.utc).timestamp() * 1000) for d in _prefix_range(prefix))


def filter_timestamps(df: DataFrame, prefixes, col: str = "timestamp") -> DataFrame:
    """A6 on raw observations: days as ranges of the epoch-millis column, so the
    filter reaches the scan (no text is made of the timestamp)."""
    cond = F.lit(False)
    for p in prefixes:
        lo, hi = _millis(str(p))
        cond = cond | ((F.col(col) >= lo) & (F.col(col) < hi))
    return df.filter(cond)


def run_days(df: DataFrame, days, op, col: str = "day"):
    """One job over many days: ``day IN (...)``, then ``op`` with the day
    as a grouping key.  Days are validated as ``yyyyMMdd``."""
    import datetime as _dt
    parsed = []
    for d in days:
        parsed.append(_dt.datetime.strptime(str(d), "%Y%m%d").date())
    return op(df.filter(F.col(col).isin(parsed)))


def audit_days(expected: DataFrame, files: DataFrame, want: int = 11,
               day_col: str = "day", file_col: str = "file_name") -> DataFrame:
    """Per expected day: present?, distinct file count, complete?"""
    per_day = files.groupBy(day_col).agg(F.countDistinct(file_col).alias("files"))
    out = expected.select(day_col).distinct().join(per_day, day_col, "left")
    n = F.coalesce(F.col("files"), F.lit(0))
    return out.select(day_col, F.col("files").isNotNull().alias("present"),
                      n.alias("files"), (n == want).alias("complete"))


def missing_days(expected: DataFrame, files: DataFrame, day_col: str = "day") -> DataFrame:
    """Expected days without any file (anti join)."""
    return expected.select(day_col).distinct().join(files.select(day_col), day_col, "left_anti")


def read_days(spark: SparkSession, path: str, schema: str, col: str = "day") -> DataFrame:
    """The rows of a day layout (``sinks.write_by_day``) with the declared columns;
    the day is the folder's, so day selections (A6) open the folders they name only."""
    return spark.read.schema(f"{schema}, `{col}` date").option("basePath", path).parquet(path)


def list_files(spark: SparkSession, path: str, glob: str = "*.json.gz") -> DataFrame:
    """File listing for A14 without reading contents (``binaryFile`` source,
    only path/length/modificationTime are selected so content is pruned)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "true").load(path)
                 .select("path", "length", "modificationTime"))


#: An ``href`` attribute, in any case, with blanks around ``=``, quoted or bare.
HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


def extract_links(pages: DataFrame, prefix: str, alternatives=None,
                  html_col: str = "html") -> DataFrame:
    """Links of index pages: the value of every ``href`` that starts with
    ``prefix`` followed by one of ``alternatives`` (or by anything) and at least
    one more character.  Prefix and alternatives are literal text."""
    found = pages.select(F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("raw"))
    link = F.trim(F.when(F.substring("raw", 1, 1).isin('"', "'"), F.expr("substring(raw, 2, char_length(raw) - 2)"))
                  .otherwise(F.col("raw")))
    keep = F.lit(False)
    for a in alternatives or [""]:
        start = prefix + a
        keep = keep | (F.startswith(F.col("link"), F.lit(start)) & (F.char_length("link") > len(start) + (not a)))
    return found.select(link.alias("link")).filter(keep)
