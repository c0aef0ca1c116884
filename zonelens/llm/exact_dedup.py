"""Exact dedup by content sort, with DataFrame operations only.

Method: the text without white space is the content.  Sampled splitters
(``repartitionByRange``) range-partition the rows by content; within each range
an external sort puts equal contents next to each other, and neighbours are
compared in full (the window's partition is the whole content).  The row with
most code points, then the smallest doc_id, stays.

Range keys are the first bytes of the content, its length and a hash of it:
equal contents have equal keys, the sample that goes to the driver stays small,
and contents with one beginning still spread over the ranges.

Hot groups: contents with more than ``SPLIT`` copies, the thousand largest of
them, get a salt in the range key, so such a group is sorted in parts of about
``SPLIT`` rows.  Each part yields its best row, and the parts' best rows (one per
part) are compared in full once more.  Any group left whole holds at most a
thousandth of all rows.

Defined results: null text counts as empty; all empty (or white) texts are equal;
a null doc_id sorts last; repeated rows are members of one group of which exactly
one row is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import ROW, cut, keep_decided, table, with_row, without_spaces

#: Copies of one content that one part of a salted group holds, and the most
#: contents that are salted (the bound of the broadcast).
SPLIT, MOST_SPLIT = 1000, 1000


def exact_groups(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the columns ``also`` of
    ``docs``: one row per row."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    keyed = (docs.select("doc_id", *also, raw.alias("text"), without_spaces(raw).alias("norm"))
             .select("doc_id", *also, "norm", F.char_length("text").cast("long").alias("chars"),
                     F.substring("norm", 1, 32).alias("head"), F.octet_length("norm").alias("size"),
                     F.xxhash64("norm").alias("h")))
    hot = (keyed.groupBy("h", "size").count().where(F.col("count") > SPLIT)
           .orderBy(F.desc("count"), "h", "size").limit(MOST_SPLIT)
           .select("h", "size", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")))
    salted = (keyed.join(F.broadcast(hot), ["h", "size"], "left")
              .withColumn("salt", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(
                  F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.coalesce("parts", F.lit(1))).cast("int"))))
    ranged = salted.repartitionByRange("head", "size", "h", "salt")
    w = (Window.partitionBy("head", "size", "h", "salt", "norm")
         .orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"), *also))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cut(ranged.select(
        "doc_id", *also, "salt", "chars", F.col("parts").isNotNull().alias("split"), "norm",
        F.first("doc_id").over(w).alias("first_id"), F.row_number().over(w).alias("place"),
        F.count(F.lit(1)).over(whole).alias("n"))
        .select("doc_id", *also, "salt", "chars", "split", "first_id", "place", "n",
                F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
                F.when(F.col("split") & (F.col("place") == 1), F.col("norm")).alias("norm")))
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("none"), "doc_id", "salt")
    parts = F.broadcast(rows.where(F.col("split") & (F.col("place") == 1)).groupBy("norm").agg(
        F.first("sha").alias("part_sha"), F.min(best).alias("best"), F.sum("n").alias("part_n")).select(
        "part_sha", F.col("best.doc_id").alias("part_keep"), F.col("best.salt").alias("best_salt"), "part_n"))  # MOST_SPLIT rows
    joined = rows.drop("norm").join(parts, F.col("split") & (F.col("sha") == F.col("part_sha")), "left")
    return joined.select(
        "doc_id", *also,
        F.when(F.col("split"), F.col("part_keep")).otherwise(F.col("first_id")).alias("keep_id"),
        F.when(F.col("split"), F.col("part_n")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("split") | (F.col("salt") == F.col("best_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row's content repeats."""
    return keep_decided(docs, exact_groups(with_row(docs), (ROW,)))


def op6_content_sort(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
           FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
