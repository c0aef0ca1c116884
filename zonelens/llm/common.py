"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.operators.order import numbered, stored  # noqa: F401
from zonelens.session import prepare_workers, work_folder, work_folders

fresh_folder = work_folder

#: The white space that every contract names: [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: its lineage ends there, and
    it is read again after the loss of an executor."""
    return stored(df, "cut")


def folder_of(df: DataFrame) -> str:
    """The work folder that ``stored`` or ``cut`` has just returned ``df`` from."""
    return work_folders(df.sparkSession)[-1]


def buckets(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batches, rows: int = 500):
    """The rows of Arrow batches, some hundred at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c))
    return text


#: Names of rows that are broadcast to the rows; longer lists are joined by a shuffle.
MOST_IDS = 1_000_000


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, a list of fixed length: it is
    broadcast, and the texts stay where they are."""
    return docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")


#: The column that names a row by its content.
ROW = "__row"


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` and ``ROW``: two 64-bit hashes of doc_id and text.  Only rows equal in
    both have the same; nulls are values like others."""
    hashes = [F.hex(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")) for seed in (1, 2)]
    return docs.withColumn(ROW, F.concat_ws("-", *hashes))


def _listed(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that are in the list ``rows`` or not; the list is counted
    first: up to ``MOST_IDS`` are broadcast."""
    rows = F.broadcast(rows) if rows.count() <= MOST_IDS else rows
    return docs.join(rows, ROW, how)


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``ROW``) that are not in ``rows``."""
    return _listed(docs, cut(rows.select(ROW).distinct()), "left_anti").drop(ROW)


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (``ROW``, kept) keeps, decided row by row;
    of rows equal in doc_id and text, one."""
    rows = cut(decided.groupBy(ROW).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"))
    keyed = _listed(with_row(docs), rows.where("NOT kept").select(ROW), "left_anti")
    again = rows.where("kept").select(ROW)
    if again.isEmpty():
        return keyed.drop(ROW)
    every = [F.col(f"`{c}`") for c in docs.columns]
    one = _listed(keyed, again, "left_semi").groupBy(ROW).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("one"))
    return _listed(keyed, again, "left_anti").drop(ROW).unionByName(one.select("one.*"))


def least_by_hash(rows: DataFrame, key: str, most) -> DataFrame:
    """Of rows (key, doc_id): per key the ``most`` (a column or number) of least hash
    of doc_id.  A cut at about three times the wanted share comes first, so that the
    ranking of a key that most rows have is no longer than that of a rare one.  Keys are
    the classes of a model that holds all of them, so their sizes are broadcast."""
    from pyspark.sql import Window

    most = most if isinstance(most, Column) else F.lit(most)
    h = F.xxhash64("doc_id")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    near = rows.join(F.broadcast(sizes), key).where(F.pmod(h, F.lit(1_000_000)) * F.col("__size") <= most.cast("long") * F.lit(3_000_000).cast("long"))
    w = Window.partitionBy(key).orderBy(F.pmod(h, F.lit(1_000_000)), h, "doc_id")
    return near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n", "__size")
