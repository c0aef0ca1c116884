"""Ranking operators: rank statistics (D4), histograms (D5, D11), name
features (J4-J6), top N per day (E1) and first-day trajectories (E2).

Scale notes
-----------
* ``rank_stats`` is one hash aggregate on ``domain`` with algebraic
  central-moment buffers: partial aggregation map-side, one shuffle.
* name features are pure projections over the (already distinct) domain
  aggregate; the entropy fold runs once per distinct name.
* ``top_n_per_day`` is ``row_number`` + ``rank <= n``: Spark plans a
  partial ``WindowGroupLimit`` before the shuffle, so a day holding a third
  of all rows is cut to n rows per task before anything moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.functions import names as N


def rank_stats(rankings: DataFrame) -> DataFrame:
    """Per domain count, min, max, avg, sample stddev/variance,
    population skewness and excess kurtosis of its daily ranks (K10)."""
    r = F.col("rank")
    return rankings.groupBy("domain").agg(
        F.count(r).alias("count"),
        F.min(r).alias("min_rank"),
        F.max(r).alias("max_rank"),
        F.avg(r).alias("avg_rank"),
        F.stddev_samp(r).alias("stddev_rank"),
        F.var_samp(r).alias("variance_rank"),
        F.skewness(r).alias("skewness_rank"),
        F.kurtosis(r).alias("kurtosis_rank"),
    )


def length_histogram(df: DataFrame, col: str = "domain") -> DataFrame:
    """Number of names per name length."""
    return (df.groupBy(N.name_length(col).alias("length"))
              .agg(F.count(col).alias("len_count")))


def day_count_histogram(stats: DataFrame) -> DataFrame:
    """Number of domains per number of ranked days."""
    return (stats.groupBy(F.col("count").alias("day_count"))
                 .agg(F.count(F.lit(1)).alias("domain_count")))


def rank_below(stats: DataFrame, limit: int) -> DataFrame:
    """Truncated average rank, kept when below ``limit``."""
    return (stats.withColumn("avg_ranking", N.truncate_rank("avg_rank"))
                 .filter(F.col("avg_ranking") < limit))


def length_vs_rank(stats: DataFrame, limit: int = 1000) -> DataFrame:
    """(name length, truncated average rank) for avg rank below limit."""
    return rank_below(stats, limit).select(
        N.name_length("domain").alias("domain_len"), "avg_ranking")


def domain_entropy(stats: DataFrame, compat: bool = False) -> DataFrame:
    """Entropy of the name without its tld, IDN names excluded."""
    parts = N.split_name("domain", compat)
    return (stats.select(parts.alias("p"))
                 .select(F.col("p.name").alias("domain"), N.entropy("p.rest").alias("entropy"))
                 .filter(N.not_idn("domain")))


def name_features(stats: DataFrame, limit: int = 100_000, compat: bool = False) -> DataFrame:
    """Length, dot count, length per digit / vowel, entropy, ideal
    entropy, gTLD flag and truncated average rank (B7-B14)."""
    parts = N.split_name("domain", compat)
    base = rank_below(stats, limit).select("domain", "avg_ranking", parts.alias("p"))
    rest = F.col("p.rest")
    rest_len = N.name_length(rest)
    return base.select(
        "domain",
        N.name_length("p.name").alias("length"),
        N.dot_count(rest).alias("dot_count"),
        N.length_per_count(rest_len, N.digit_count(rest)).alias("digit_ratio"),
        N.length_per_count(rest_len, N.vowel_count(rest)).alias("vowel_ratio"),
        N.entropy(rest).alias("entropy"),
        N.entropy_ideal(rest_len).alias("ideal_entropy"),
        N.is_gtld("p.tld").alias("is_gtld"),
        "avg_ranking",
    )


def top_n_per_day(rankings: DataFrame, n: int = 100, exclude: str | None = "google",
                  day_col: str = "day") -> DataFrame:
    """Per day drop names containing ``exclude``, keep the first ``n`` by
    rank and renumber them 1..n (K13: exactly n; the reference yields n+1).
    Rejected (null) ranks take no part; ``rejected_input`` counts them."""
    kept = rankings.filter(F.col("rank").isNotNull())
    kept = kept if exclude is None else kept.filter(N.without_keyword("domain", exclude))
    w = Window.partitionBy(day_col).orderBy(F.col("rank"), F.col("domain"))
    return (kept.withColumn("new_rank", F.row_number().over(w))
                .filter(F.col("new_rank") <= n)
                .select("domain", F.col("rank").alias("alexa_rank"),
                        F.col("new_rank").cast("int").alias("rank"),
                        F.date_format(day_col, "yyyyMMdd").alias("date")))


def first_day_trajectories(rankings: DataFrame, n: int = 100, exclude: str | None = "google",
                           k: int = 5, day_col: str = "day") -> DataFrame:
    """E2 (with G3): the top-list rows of every day for the first ``k`` domains of
    the earliest day, in rank order (distinct values in order of appearance).

    The earliest day is a scalar over the rankings themselves, so it restricts the
    scan before any window, and the k leaders are a ``TakeOrderedAndProject`` on that
    one day; the windowed top list is computed once and semi-joined with them.
    """
    ranked = rankings.filter(F.col("rank").isNotNull())
    ranked = ranked if exclude is None else ranked.filter(N.without_keyword("domain", exclude))
    first = ranked.select(F.min(day_col)).scalar()
    leaders = (ranked.filter(F.col(day_col) == first)
                     .orderBy("rank", "domain").limit(min(k, n)).select("domain"))
    return top_n_per_day(rankings, n, exclude, day_col).join(leaders, "domain", "left_semi")


def trajectory(top: DataFrame, domains) -> DataFrame:
    """Rows of the named domains.  ``domains`` is a list of names (an IN-list), or a
    DataFrame with a column ``domain``: then an equi-join (semi), which the planner
    broadcasts below its threshold and shuffles beyond, so the list may be of any length."""
    if isinstance(domains, DataFrame):
        return top.join(domains.select("domain"), "domain", "left_semi")
    return top.filter(F.col("domain").isin(list(domains)))
