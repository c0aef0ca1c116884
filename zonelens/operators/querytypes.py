"""Query-type report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Query types plotted per month, in plot order.
PLOTTED_QUERY_TYPES = ("CNAME", "NS", "SOA", "MX", "A", "TXT")


def query_type_counts(obs: DataFrame, by=("day",)) -> DataFrame:
    """Answers per day and query type (what the notebook reads)."""
    return obs.groupBy(*by, "query_type").agg(F.count(F.lit(1)).alias("count"))


def row_multiplicity(df: DataFrame) -> DataFrame:
    """How often each whole row occurs (what the script computes, K3)."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("count"))
