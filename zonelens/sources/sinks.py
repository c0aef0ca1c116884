"""Sinks (A8-A13).  All writes are distributed but the single-file sink (A10),
which is for results that are small by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.functions.records import prune_falsy


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip JSON lines."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None,
              mode: str = "overwrite") -> None:
    """Headerless CSV, plain or compressed."""
    w = df.write.mode(mode).option("header", "false")
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_single(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A10: one output file, for a result the caller knows to be small (after an
    aggregate or a limit).

    ``repartition(1)`` moves only the finished rows into one task; what computes
    them keeps its own parallelism.
    """
    df.repartition(1).write.mode(mode).format(fmt).option("header", "false").save(path)


def write_counters(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counters as JSON lines with named columns."""
    df.write.mode(mode).json(path)


def write_by_day(df: DataFrame, path: str, col: str = "date", fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """One folder per day (``col=value``): replaces renaming part files.

    Rows are clustered by the day with a ``rebalance`` hint so each task
    writes few files; AQE splits a day that holds a large share of the rows
    over several tasks (``optimizeSkewsInRebalancePartitions``) instead of
    funnelling it through one writer.
    """
    (df.hint("rebalance", col).write.mode(mode).partitionBy(col).format(fmt)
       .option("compression", "gzip" if fmt == "json" else "snappy").save(path))


def rewrite_days(df: DataFrame, path: str, days=None, col: str = "day", fmt: str = "parquet") -> None:
    """A12 again: replaces the days that ``df`` holds in a day layout and leaves the
    others as they are (dynamic partition overwrite), so a day's job can be run once more.

    ``days`` (DATEs) are the days that were run: one of them that has no rows this time
    is emptied, which the overwrite alone would not do."""
    spark = df.sparkSession
    (df.hint("rebalance", col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).format(fmt)
       .option("compression", "gzip" if fmt == "json" else "snappy").save(path))
    if days is None:
        return
    have = {r[0] for r in df.select(col).distinct().collect()}  # a row per day
    context = spark.sparkContext
    for day in set(days) - have:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{col}={day}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def convert_raw(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Source rows -> falsy fields dropped (B5) -> gzip JSON lines."""
    df.select(prune_falsy(df).alias("value")).write.mode(mode) \
      .option("compression", "gzip").text(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as compact JSON text (the reference's ``json.dumps`` role)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_bucketed(df: DataFrame, table: str, buckets: int, cols=("domain",),
                   mode: str = "overwrite", path: str | None = None) -> None:
    """Store observations bucketed (and sorted) by domain.

    A later ``groupBy(domain, date)`` or join on ``domain`` over the table is
    already clustered by domain, so Spark plans it without an Exchange: the
    partition-local compaction the reference aimed for, without its
    one-file-one-day assumption (K5).  ``path`` puts the files there instead of the
    warehouse.  Rows are dealt out by bucket first, so a bucket is one file, not one per task.
    """
    writer = df.repartition(buckets, *cols).write.mode(mode).format("parquet").bucketBy(buckets, *cols).sortBy(*cols)
    (writer.option("path", path) if path else writer).saveAsTable(table)
