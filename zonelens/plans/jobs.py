"""Composite jobs (J1-J10): the end-user entry points, each one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.functions.names import not_idn
from zonelens.operators import rankings as R
from zonelens.operators import records as REC
from zonelens.operators import stats as S
from zonelens.operators import txt as T
from zonelens.operators.soa import soa_ranges
from zonelens.schemas import DAY_FEATURE_COLUMNS

# Columns correlated per day in the rank/record-count report.
CORR_DAY_COLUMNS = ("DNSKEY", "DS", "RRSIG", "CAA", "NSEC", "SOA", "NS", "A", "AAAA",
                    "CNAME", "MX", "TXT", "SPF", "PTR", "alexa_rank")
# Columns correlated over a month of joined features.
CORR_MONTH_COLUMNS = ("alexa_rank", "SOA", "NS", "A", "AAAA", "CNAME", "MX", "SPF", "DS", "PTR",
                      "DNSKEY")
# Numeric name-feature columns correlated with the average rank.
CORR_NAME_COLUMNS = ("length", "dot_count", "digit_ratio", "vowel_ratio", "entropy",
                     "ideal_entropy", "avg_ranking")


def month_features(rankings: DataFrame, obs: DataFrame, mode: str = "strict") -> DataFrame:
    """Rankings joined with record-set features on (domain, date).

    No record sets are made: both ``strict`` and ``text`` counts (K7) are sums over
    distinct lines.
    """
    feats = REC.record_counts(obs, mode)
    return REC.join_rank_records(REC.rankings_by_date(rankings), feats, ("domain", "date"))


def day_features(rankings: DataFrame, obs: DataFrame, days=None, mode: str = "strict") -> DataFrame:
    """Per-day features; ``days`` (DATEs) restrict both sides before the
    join, otherwise every day is processed in one job with ``date`` as key."""
    if days is not None:
        rankings = rankings.filter(F.col("day").isin(list(days)))
        obs = obs.filter(F.col("day").isin(list(days)))
    joined = month_features(rankings, obs, mode)
    return joined.select("date", *DAY_FEATURE_COLUMNS)


def join_preview(rankings: DataFrame, obs: DataFrame, n: int = 10) -> DataFrame:
    """First rows of the join under a total order.

    The first n keys of the join are found on keys alone (a semi join and a
    ``TakeOrderedAndProject``); records are counted for these keys only.
    """
    on = ["domain", "date"]
    keyed = REC.with_keys(obs)
    first = (REC.rankings_by_date(rankings).dropna(subset=["alexa_rank"])
                .join(keyed.select(*on).distinct(), on, "left_semi").orderBy(*on).limit(n))
    counts = REC.record_counts(keyed.join(first.select(*on), on, "left_semi"))
    return S.preview(first.join(counts, on), n, on)


def length_vs_rank(rankings: DataFrame, limit: int = 1000) -> DataFrame:
    """J4."""
    return R.length_vs_rank(R.rank_stats(rankings), limit)


def entropy_table(rankings: DataFrame, compat: bool = False) -> DataFrame:
    """J5."""
    return R.domain_entropy(R.rank_stats(rankings), compat)


def name_feature_table(rankings: DataFrame, limit: int = 100_000) -> DataFrame:
    """J6."""
    return R.name_features(R.rank_stats(rankings), limit)


def txt_report(obs: DataFrame, compat: bool = False) -> DataFrame:
    """Per day basic counters, label counts and sensitive-row count in
    one long table (section, label, n), in one pass: each answer yields its
    (section, label) pairs and the pairs are counted per day.  The counters of a
    day are 0 where it has no such answer; labels without texts have no row.
    ``txt_sensitive`` gives the sensitive rows themselves."""
    return T.txt_report_counts(obs, compat)


def txt_sensitive(obs: DataFrame, compat: bool = False) -> DataFrame:
    """J7's second output: the sensitive rows (day, text, name)."""
    return T.sensitive_txt(obs, compat)


def soa_report(obs: DataFrame, compat: bool = False) -> DataFrame:
    """J8."""
    return soa_ranges(obs, compat=compat)


def rank_record_correlation(rankings: DataFrame, obs: DataFrame, days=None) -> DataFrame:
    """Per day Pearson matrix of record counts and rank."""
    feats = day_features(rankings, obs, days)
    return S.correlation_matrix(feats, list(CORR_DAY_COLUMNS), by=("date",))


# Entropy bands of the random-name report (lo, hi, lo_closed, hi_closed).
ENTROPY_BANDS = {
    "(2,3]": (2.0, 3.0, False, True),
    "(3,4)": (3.0, 4.0, False, False),
    "[4,4.2)": (4.0, 4.2, True, False),
    "[4.2,4.3)": (4.2, 4.3, True, False),
    "[4.5,inf)": (4.5, None, True, False),
    "(2.3,inf)": (2.3, None, False, False),
    "(3.9,inf)": (3.9, None, False, False),
    "(4.2,inf)": (4.2, None, False, False),
}


def random_name_bands(entropy: DataFrame) -> DataFrame:
    """Number of names per entropy band, one scan with conditional counts."""
    aggs = []
    for name, (lo, hi, lc, hc) in ENTROPY_BANDS.items():
        e = F.col("entropy")
        cond = (e >= lo) if lc else (e > lo)
        if hi is not None:
            cond = cond & ((e <= hi) if hc else (e < hi))
        aggs.append(F.count_if(cond).alias(name))
    wide = entropy.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in ENTROPY_BANDS)
    return wide.select(F.expr(f"stack({len(ENTROPY_BANDS)}, {stack}) AS (band, n)"))


def random_name_heads(entropy: DataFrame, lo: float = 4.1, k: int = 20) -> DataFrame:
    """The k lowest-entropy names above a threshold."""
    return S.bottom_above(entropy, "entropy", lo, k, tie="domain")


def idn_removed(stats: DataFrame) -> DataFrame:
    """D22 on the entropy job: names the IDN filter removes."""
    return S.removed_count(stats, ~not_idn("domain"))
