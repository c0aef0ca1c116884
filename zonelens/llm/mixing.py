"""Mixing sources to target weights by capped water-filling.

Method: the size of a document is its number of words.  Sources in code-point
order (null last) weigh 5, 2, 1, 5, 2, 1, ...; the total size is shared by weight.
A source stops at ``max_epochs`` times its own size; what it cannot take is shared
again by weight until no source is above its limit.  That fixpoint is level L with
target = min(limit, L * weight): sources sorted by limit / weight fill up first, so
running sums over the sources (one small row each) give L without a loop.

Each source then takes its target: every document floor(target / source size) whole
times, and one more repetition goes to documents in seeded order (md5 of seed and
doc_id) until the rest is used up; the document at the edge gives the fraction that
is left.  A source's taken words therefore equal its rounded target.

Scale: documents are counted once and kept as small rows.  A source may hold any
share of the rows: its seeded order is cut into 4,096 hash ranges, range totals are
summed (map-side partial sums), and only the one range in which the target falls is
ordered document by document.

Defined results: null or empty text has size 0 and takes 0 words; sources of size 0
have target 0; null source is a source of its own; equal doc_ids are ordered by
size, equal rows in any order (their results are equal as a set); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import WORD, cut, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"


def _targets(totals: DataFrame, weights, max_epochs: int) -> DataFrame:
    """source, source_size, target: one row per source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * float(max_epochs))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                             / F.sum("weight").over(after))
                .withColumn("open", F.col("level") * F.col("weight") <= F.col("most")))
    # the first source that does not fill up sets the level for itself and all later ones
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every.orderBy(
        F.col("most") / F.col("weight"), F.asc_nulls_last("source")))
    return levelled.withColumn("final", level).select(
        "source", "source_size",
        F.coalesce(F.least("most", F.col("final") * F.col("weight")), F.col("most")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row."""
    sized = cut(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"))
        .withColumn("range", F.substring("draw", 1, 3)))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    plan = _targets(totals, weights, max_epochs)
    plan = plan.withColumn("want", F.round("target").cast("long")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
    in_order = Window.partitionBy("source").orderBy("range")
    up_to = ranges.withColumn("upto", F.sum("range_size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    p, r = plan.alias("p"), up_to.alias("r")
    cells = p.join(r, F.expr("p.source <=> r.source")).select(
        F.col("p.source").alias("c_source"), F.col("range").alias("c_range"), "source_size", "target", "whole", "rest",
        (F.col("upto") - F.col("range_size")).alias("before"), "upto")
    joined = sized.join(cells, sized["source"].eqNullSafe(cells["c_source"]) & (sized["range"] == cells["c_range"]))
    # only the range that holds the edge needs the documents' own order
    edge = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("upto"))
    same = ["doc_id", "source", "size", "source_size", "target"]
    plain = joined.where(~edge).select(*same, (F.col("whole") * F.col("size") + F.when(
        F.col("upto") <= F.col("rest"), F.col("size")).otherwise(0)).alias("taken"))
    w = (Window.partitionBy("source", "range").orderBy("draw", "size")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.col("before") + F.col("run") - F.col("size")
    cut_in = joined.where(edge).withColumn("run", F.sum("size").over(w)).select(
        *same, (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - at))).alias("taken"))
    return plain.unionByName(cut_in)


def op4_water_filling(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || doc_id) AS draw,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
      [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size AS most,
      (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM f),
t AS (SELECT source, source_size, least(most, weight * (SELECT arg_min(level, (most / weight, source)) FROM l
        WHERE level * weight <= most)) AS target FROM l),
p AS (SELECT *, round(target)::BIGINT AS want, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.want - p.whole * p.source_size AS rest,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
