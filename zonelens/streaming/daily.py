"""Structured Streaming form of the per-day reports.

The reference runs these as one batch job per day over static files.  The
same operators are plain grouped counts, so they run unchanged on a
streaming DataFrame: new observation files are picked up as they land,
``event_time`` (from the epoch-millis ``timestamp``) carries a watermark,
and the day is a one-day tumbling window, so a day's counts are final and
emitted (append mode) once the watermark passes its end.  State is bounded:
one row per (open day, key).

The checkpoint location defaults to a folder under the session's
``spark.checkpoint.dir`` (the shared folder the cluster names).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.operators import querytypes as QT
from zonelens.operators import soa as SOA
from zonelens.operators import txt as T
from zonelens.schemas import observation_schema
from zonelens.session import checkpoint_dir


def observation_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                       fmt: str = "json") -> DataFrame:
    """Streaming scan of raw observation files with the fixed schema."""
    reader = spark.readStream.schema(observation_schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.format(fmt).load(path)
    return df.withColumn("event_time", F.timestamp_millis("timestamp"))


def _by_day(df: DataFrame, lateness: str):
    w = df.withWatermark("event_time", lateness)
    return w, (F.window("event_time", "1 day").alias("window"),)


def _flatten(df: DataFrame) -> DataFrame:
    return df.select(F.to_date(F.col("window.start")).alias("day"),
                     *[c for c in df.columns if c != "window"])


def daily_query_types(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """D9 per closed day."""
    w, by = _by_day(stream, lateness)
    return _flatten(QT.query_type_counts(w, by=by))


def daily_txt_basic(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """D6 per closed day."""
    w, by = _by_day(stream, lateness)
    return _flatten(T.txt_basic(w, by=by))


def daily_txt_labels(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """D7 per closed day."""
    w = (stream.withWatermark("event_time", lateness)
               .withColumn("window", F.window("event_time", "1 day")))
    return _flatten(T.txt_label_counts(w, by=("window",)))


def daily_soa(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """D8 per closed day."""
    w, by = _by_day(stream, lateness)
    return _flatten(SOA.soa_ranges(w, by=by))


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None,
          checkpoint: str | None = None, available_now: bool = False, mode: str = "append"):
    """Start a streaming query with a reliable checkpoint folder."""
    spark = df.sparkSession
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).queryName(name)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.format(sink).start(path)
