"""Registrable domain by public-suffix rules (C3) and grouping by it.

The reference walks a per-string rule tree.  Here the rules are a table and
matching is an **equi-join**: every suffix of a name becomes up to three
candidate keys (the literal suffix, the wildcard form ``*.<parent>``, the
exception form ``!<suffix>``), candidates are joined with the rules on
``key = rule``, and the best match per name wins (an exception first, then
the public suffix with the most labels).  Names are de-duplicated before the
join, so the work grows with distinct names, not with observations.  The
rules side is small and bounded by the published list; the planner
broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold`` and falls
back to a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.functions.names import is_ipv4, normalise_host
from zonelens.functions.records import short_line


def rules_table(spark, lines) -> DataFrame:
    """Rules from list text: comments and blank lines dropped, normalised."""
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    return parse_rules(df)


def parse_rules(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    keep = line.isNotNull() & ~line.startswith("//") & (F.trim(line) != "")
    return df.filter(keep).select(normalise_host(line).alias("rule")).filter(F.col("rule") != "")


def _candidates(host):
    labels = F.split(host, "[.]")
    n = F.size(labels)

    def suffix(i):
        return F.array_join(F.slice(labels, i + 1, n - i), ".")

    def cands(i):
        lit = F.struct(suffix(i).alias("key"), F.lit(0).alias("kind"), (n - i).alias("ps_len"))
        wild = F.struct(F.when(i < n - 1, F.concat(F.lit("*."), suffix(i + 1))).alias("key"),
                        F.lit(0).alias("kind"), (n - i).alias("ps_len"))
        exc = F.struct(F.concat(F.lit("!"), suffix(i)).alias("key"), F.lit(1).alias("kind"),
                       (n - i - 1).alias("ps_len"))
        return F.array(lit, wild, exc)

    per_pos = F.transform(F.sequence(F.lit(0), n - 1), cands)
    return F.filter(F.flatten(per_pos), lambda c: c["key"].isNotNull())


def registrable_domain(names: DataFrame, rules: DataFrame, col: str = "host",
                       out: str = "registrable_domain") -> DataFrame:
    """Add the registrable domain (public suffix + one label) of ``col``.

    IPv4 hosts pass through unchanged; names without a matching rule, or
    equal to their public suffix, get null.
    """
    norm = normalise_host(F.col(col))
    distinct = (names.select(norm.alias("_h")).filter(F.col("_h").isNotNull()
                                                      & (F.col("_h") != "")).distinct())
    cand = distinct.select("_h", F.inline(_candidates(F.col("_h"))))
    matched = cand.join(rules.select(F.col("rule").alias("key")), "key")
    # exception beats literal/wildcard, then the longest public suffix; a
    # numeric score keeps the per-name maximum a hash aggregate (a DNS name
    # has at most 127 labels)
    score = F.col("kind") * 1000 + F.col("ps_len")
    best = matched.groupBy("_h").agg(F.max(score).alias("b"))
    labels = F.split(F.col("_h"), "[.]")
    n = F.size(labels)
    k = (F.col("b") % 1000).cast("int")
    reg = F.when(k < n, F.array_join(F.slice(labels, n - k, k + 1), "."))
    resolved = best.select("_h", reg.alias("_reg"))
    joined = (names.withColumn("_h", norm)
                   .join(resolved, "_h", "left"))
    value = F.when(is_ipv4(F.col("_h")), F.col("_h")).otherwise(F.col("_reg"))
    return joined.withColumn(out, value).drop("_h", "_reg")


def group_by_registrable(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Display lines per registrable domain of ``response_name``.

    Long form (registrable_domain, line, n).  Observations are first counted
    per (host, line), so the join with the resolved hosts sees distinct
    pairs, not every answer; a hot domain stays spread over tasks and is
    never gathered into one list.
    """
    pre = (obs.filter(F.col("response_name").isNotNull())
              .groupBy(F.col("response_name").alias("host"), short_line().alias("line"))
              .agg(F.count(F.lit(1)).alias("n")))
    reg = registrable_domain(pre, rules, col="host")
    return (reg.filter(F.col("registrable_domain").isNotNull())
               .groupBy("registrable_domain", "line")
               .agg(F.sum("n").alias("n")))
