"""Record-set operators: compaction (D1/D2/F1/G2), raw grouping (D3) and the
rankings-records join (C1/C2, B24/B25).

Scale notes
-----------
* ``record_lines`` / ``record_counts`` are the forms that jobs use: distinct
  lines and counts, no arrays, so no zone is gathered in one row.
* ``record_parts`` / ``group_record_parts`` write a zone as ordered parts of bounded
  length; ``compact_records`` (the reference's output: the list of a zone in one row) is
  one ``groupBy(domain, date)`` with ``collect_set``, duplicates removed map-side.
* ``group_records`` keeps duplicates as a multiplicity ``n`` instead of
  repeating objects: a domain measured millions of times a day still yields
  one entry per distinct pruned object.
* the join is a plain equi-join on real two-column keys (no composite
  ``domain-date`` strings): sort-merge at scale, AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.functions.names import day_key, normalise_domain
from zonelens.functions.records import COUNTED_TYPES, line_counts, line_type, prune_falsy, record_line, type_counts
from zonelens.operators.order import ordered_parts


def with_keys(obs: DataFrame) -> DataFrame:
    """Real (domain, date) key columns instead of a ``domain-date`` string."""
    return (obs.withColumn("domain", normalise_domain("query_name"))
               .withColumn("date", day_key("timestamp")))


def compact_records(obs: DataFrame) -> DataFrame:
    """(domain, date) -> distinct record lines sorted by (type, line).

    Groups whose answers all lack a response name keep an empty list.  When
    ``obs`` already carries ``domain``/``date`` (e.g. a table bucketed by
    domain, D2) they are used as they are, so the grouping needs no shuffle.
    """
    keyed = obs if {"domain", "date"} <= set(obs.columns) else with_keys(obs)
    keyed = keyed.withColumn("line", record_line("domain"))
    entry = F.when(F.col("line").isNotNull(),
                   F.struct(line_type("line").alias("t"), F.col("line").alias("line")))
    return (keyed.groupBy("domain", "date")
                 .agg(F.array_sort(F.collect_set(entry)).alias("_set"))
                 .select("domain", "date",
                         F.transform("_set", lambda x: x["line"]).alias("records")))


def record_lines(obs: DataFrame) -> DataFrame:
    """D1 in long form: (domain, date, type, line), each distinct line once.

    Nothing is gathered per zone: a zone with any number of lines spreads over
    tasks.  Groups whose answers all lack a response name keep one row with a
    null line.
    """
    keyed = obs if {"domain", "date"} <= set(obs.columns) else with_keys(obs)
    return (keyed.select("domain", "date", record_line("domain").alias("line")).distinct()
                 .select("domain", "date", line_type("line").alias("type"), "line"))


def record_counts(obs: DataFrame, mode: str = "strict") -> DataFrame:
    """B24 without arrays: total and per-type counts of distinct lines.

    Distinct lines first, each named by 128 bits of hash and carrying what it adds to the
    counts, so no line's text is shuffled; then one row of counts per (domain, date): the
    second shuffle carries partial counts only, and the lines of a hot zone never meet.
    ``text`` counts (K7) are sums over lines, too.
    """
    keyed = obs if {"domain", "date"} <= set(obs.columns) else with_keys(obs)
    lines = keyed.select("domain", "date", record_line("domain").alias("line"))
    ids = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    there = F.col("line").isNotNull().alias("there")
    if mode == "strict":  # the type says it all
        distinct = lines.select("domain", "date", there, line_type("line").alias("type"), *ids).distinct()
        adds = [F.count_if(F.col("type") == t).cast("int").alias(t) for t in COUNTED_TYPES]
    else:
        distinct = lines.select("domain", "date", there, *ids, *line_counts("line", mode)).groupBy("domain", "date", "there", "h1", "h2").agg(
            *[F.first(t).alias(t) for t in COUNTED_TYPES])
        adds = [F.coalesce(F.sum(t), F.lit(0)).cast("int").alias(t) for t in COUNTED_TYPES]
    return distinct.groupBy("domain", "date").agg(F.count_if("there").cast("int").alias("records_count"), *adds)


def record_parts(obs: DataFrame, most: int = 1000) -> DataFrame:
    """D1 as ordered parts: (domain, date, part, records), the zone's distinct lines by
    (type, line) in parts of at most ``most``.  A secondary sort over all tasks: a zone
    of any size is written by many of them, and its parts in a row are its record set."""
    return ordered_parts(record_lines(obs), ("domain", "date"), ("type", "line"), F.col("line"), most).withColumnRenamed("values", "records")


def group_record_parts(obs: DataFrame, most: int = 1000) -> DataFrame:
    """D3 as ordered parts: (domain, date, part, records), the zone's distinct objects
    with their multiplicity by JSON text, at most ``most`` in a part."""
    return ordered_parts(group_records(obs), ("domain", "date"), ("record",), F.struct("record", "n"), most).withColumnRenamed("values", "records")


def group_records(obs: DataFrame, nested: bool = False) -> DataFrame:
    """D3: (domain, date, record, n): distinct falsy-pruned observation objects
    (timestamp dropped) with their multiplicity, after a single aggregation.

    ``nested=True`` gathers a zone's objects in one row, sorted by the JSON text, as the
    reference's output has them; ``group_record_parts`` is the form for zones of any size.
    """
    keyed = with_keys(obs)
    payload_cols = [c for c in obs.columns if c != "timestamp"]
    obj = prune_falsy(obs.select(*payload_cols))
    per_obj = (keyed.select("domain", "date", obj.alias("record"))
                    .groupBy("domain", "date", "record").agg(F.count(F.lit(1)).alias("n")))
    if not nested:
        return per_obj
    return (per_obj.groupBy("domain", "date")
                   .agg(F.array_sort(F.collect_list(F.struct("record", "n"))).alias("records")))


def record_features(records: DataFrame, mode: str = "strict") -> DataFrame:
    """Total and per-type counts of each record set."""
    return records.select("domain", "date", F.size("records").alias("records_count"),
                          *type_counts("records", mode))


def join_rank_records(rankings: DataFrame, records: DataFrame,
                      on=("domain", "date")) -> DataFrame:
    """Inner equi-join of rankings with record features.  Rejected
    (null) ranks take no part; ``rejected_input`` counts them."""
    ranks = [c for c in ("rank", "alexa_rank") if c in rankings.columns]
    kept = rankings.dropna(subset=ranks) if ranks else rankings
    return kept.join(records, list(on), "inner")


def join_bucketed(rankings: DataFrame, obs: DataFrame) -> DataFrame:
    """C1 and D1 over two tables bucketed alike by (domain, date) (``sinks.write_bucketed``):
    rankings (domain, date, ...) and observations with their keys.  Distinct lines, counts
    and the join all find a zone's rows of a day in one bucket, so nothing is shuffled or
    broadcast; a domain of many days lies in several buckets."""
    return join_rank_records(rankings.hint("merge"), record_counts(obs), ("domain", "date"))


def rankings_by_date(rankings: DataFrame) -> DataFrame:
    """Rankings keyed like record sets: ``date`` as ``yyyyMMdd`` text."""
    return rankings.select("domain", F.date_format("day", "yyyyMMdd").alias("date"),
                           F.col("rank").alias("alexa_rank"))
