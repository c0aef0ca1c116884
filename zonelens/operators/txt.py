"""TXT report operators.

The reference scans the day three times (basic counters, labels, sensitive
rows); here the counts of the report are one pass (``txt_report_counts``), the
sensitive rows a second output, and ``day`` is a grouping key so many days run as
one job (A7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.functions.txt import TXT_TAXONOMY, clean_txt, is_correct_txt, is_sensitive, txt_labels


def txt_basic(obs: DataFrame, by=("day",), compat: bool = False) -> DataFrame:
    """Per day total answers (``dns``), TXT answers and non-empty TXT."""
    rt = F.col("response_type")
    return obs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(rt == "TXT").alias("txt"),
        F.count_if(is_correct_txt(rt, "txt_text", compat)).alias("correct_txt"),
    )


def txt_basic_long(basic: DataFrame, by=("day",)) -> DataFrame:
    """D6 in the reference's long (label, n) form: dns / txt / correct_txt."""
    return basic.select(*by, F.expr(
        "stack(3, 'dns', total, 'txt', txt, 'correct_txt', correct_txt) AS (label, n)"))


def txt_rows(obs: DataFrame, compat: bool = False, keep=("day",)) -> DataFrame:
    """TXT answers as (text, name) with the cleaned, non-empty text
    (plus the ``keep`` key columns that exist)."""
    return (obs.filter(F.col("response_type") == "TXT")
               .select(*[c for c in keep if c in obs.columns],
                       clean_txt("txt_text", compat).alias("text"),
                       F.col("response_name").alias("name"))
               .filter(F.col("text") != ""))


def txt_label_counts(obs: DataFrame, by=("day",), compat: bool = False) -> DataFrame:
    """Per day, number of TXT texts carrying each taxonomy label."""
    rows = txt_rows(obs, compat, keep=by)
    return (rows.select(*by, F.explode(txt_labels("text")).alias("label"))
                .groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")))


def sensitive_txt(obs: DataFrame, compat: bool = False) -> DataFrame:
    """TXT rows whose text names a login, user, password ... ."""
    return txt_rows(obs, compat).filter(is_sensitive("text"))


def txt_report_counts(obs: DataFrame, compat: bool = False, by=("day",)) -> DataFrame:
    """J7 in one scan and one aggregate: per day (section, label, n).

    An answer is one row without a label, which the basic counters and the sensitive
    texts are counted on, and one more row for each of its labels; the finished counts of
    a day's unlabelled rows are laid out as rows at the end.
    """
    rt, text = F.col("response_type"), F.col("_text")
    obs = obs.select(*by, "response_type", "txt_text", clean_txt("txt_text", compat).alias("_text"))
    is_txt = F.coalesce(rt == "TXT", F.lit(False))
    is_row = F.coalesce((rt == "TXT") & (text != ""), F.lit(False))
    none = F.array(F.lit(None).cast("string"))
    marked = obs.select(
        *by, is_txt.alias("txt"), F.coalesce(is_correct_txt(rt, "txt_text", compat), F.lit(False)).alias("correct"),
        (is_row & is_sensitive("_text")).alias("sensitive"),
        F.explode(F.when(is_row, F.concat(none, txt_labels("_text"))).otherwise(none)).alias("label"))
    counts = marked.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("txt").alias("txt"), F.count_if("correct").alias("correct"), F.count_if("sensitive").alias("sensitive"))
    pair = lambda section, label, n: F.struct(F.lit(section).alias("section"), label.alias("label"), n.alias("n"))
    basic = F.array(pair("basic", F.lit("dns"), F.col("n")), pair("basic", F.lit("txt"), F.col("txt")),
                    pair("basic", F.lit("correct_txt"), F.col("correct")), pair("sensitive", F.lit("sensitive"), F.col("sensitive")))
    rows = F.when(F.col("label").isNull(), F.filter(basic, lambda x: (x["section"] == "basic") | (x["n"] > 0))).otherwise(
        F.array(pair("specific", F.col("label"), F.col("n"))))
    return counts.select(*by, F.inline(rows))


def txt_shares(obs: DataFrame, name=None, within: str | None = None, compat: bool = False) -> DataFrame:
    """D20 for TXT labels in one scan: label counts, the texts without a label as
    ``other``, and shares of all texts.

    ``name`` maps a label to what is reported (default: its category); ``within``
    keeps the labels of one category and takes their texts as the total.  With
    ``compat`` the other bucket is the total minus the sum of labels (K12).
    """
    name = name or category_of
    labels = txt_labels("text")
    if within is not None:
        labels = F.filter(labels, lambda x: category_of(x) == within)
    texts = txt_rows(obs, keep=()).select(labels.alias("labels"))
    if within is not None:
        texts = texts.filter(F.size("labels") > 0)
    marks = F.concat(F.array(F.lit("\u0000total")), F.transform("labels", name),
                     F.when(F.size("labels") == 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")))
    counts = texts.select(F.explode(marks).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _with_shares(counts, within is None, compat)


def value_shares(df: DataFrame, col: str, values) -> DataFrame:
    """D20 for a column in one scan: rows per listed value, all others as ``other``."""
    marks = F.array(F.lit("\u0000total"), F.when(F.col(col).isin(list(values)), F.col(col)).otherwise("other"))
    counts = df.select(F.explode(marks).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _with_shares(counts, True, False)


def _with_shares(counts: DataFrame, other: bool, compat: bool) -> DataFrame:
    """Shares of the total that is counted under its own mark.  The counts are one
    row per label; they become one row of arrays and are unpacked again."""
    is_total = F.col("label") == "\u0000total"
    row = counts.agg(
        F.coalesce(F.max(F.when(is_total, F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~is_total & (F.col("label") != "other"), F.col("n"))), F.lit(0)).alias("labelled"),
        F.coalesce(F.max(F.when(F.col("label") == "other", F.col("n"))), F.lit(0)).alias("other"),
        F.collect_list(F.when(~is_total & (F.col("label") != "other"), F.struct("label", "n"))).alias("rows"))
    rest = F.array(F.struct(F.lit("other").alias("label"),
                            (F.col("total") - F.col("labelled") if compat else F.col("other")).cast("long").alias("n")))
    rows = F.concat("rows", rest) if other else F.col("rows")
    return row.select("total", F.inline(rows)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def unlabelled_count(obs: DataFrame, by=("day",), compat: bool = False) -> DataFrame:
    """Texts without any label: the native "other" bucket."""
    rows = txt_rows(obs, compat, keep=by)
    return (rows.groupBy(*by)
                .agg(F.count_if(F.size(txt_labels("text")) == 0).alias("n")))


def category_of(label) -> F.Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.substring_index(label, ".", 1)


def category_rollup(counts: DataFrame, by=("day",)) -> DataFrame:
    """Label counts plus category totals and a grand total per day.

    ``rollup(category, label)``; ``level`` is 0 for a label row, 1 for a
    category total, 3 for the day total.
    """
    c = counts.withColumn("category", category_of("label"))
    return (c.rollup(*by, "category", "label")
             .agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
             .filter(F.col("level") <= 3))


def month_pivot(counts: DataFrame, values, label_col: str = "label",
                time_col: str = "day", n_col: str = "n") -> DataFrame:
    """Month x label matrix with an explicit value list (no extra scan
    to discover the pivot values)."""
    m = counts.withColumn("month", F.date_format(time_col, "yyyy-MM"))
    return m.groupBy("month").pivot(label_col, list(values)).agg(F.sum(n_col))


def shares_with_other(counts: DataFrame, total: DataFrame, label_col: str = "label",
                      n_col: str = "n", other: DataFrame | None = None,
                      compat: bool = False) -> DataFrame:
    """Per-label counts with an ``other`` bucket and shares of the total.

    ``total`` is a one-row DataFrame with column ``total``.  Natively the
    other bucket is counted (``other`` DataFrame with column ``n``); with
    ``compat`` it is total minus the sum of labels, as the reference does.
    """
    labelled = counts.groupBy(label_col).agg(F.sum(n_col).alias("n"))
    tot = total.select(F.col("total").cast("long").alias("total"))
    t = tot.scalar()
    if compat or other is None:
        other_row = labelled.agg((F.lit(t) - F.coalesce(F.sum("n"), F.lit(0))).alias("n"))
    else:
        other_row = other.agg(F.sum("n").alias("n"))
    rows = labelled.unionByName(other_row.select(F.lit("other").alias(label_col), "n"))
    return rows.select(label_col, F.col("n").cast("long").alias("n"),
                       (F.col("n") / F.lit(t)).alias("share"))


def max_share(basic: DataFrame, num: str = "txt", den: str = "total", time_col: str = "day") -> DataFrame:
    """Highest num/den share over days and the day it occurs."""
    share = F.col(num) / F.col(den)
    return basic.agg(F.max(share).alias("max_share"),
                     F.max_by(F.col(time_col), F.struct(share, F.col(time_col))).alias("max_day"))


def with_txt_shares(basic: DataFrame) -> DataFrame:
    """Txt share of all answers and number of empty TXT answers."""
    return basic.withColumn("txt_share", F.col("txt") / F.col("total")) \
                .withColumn("empty_txt", F.col("txt") - F.col("correct_txt"))


def label_names() -> list[str]:
    return list(TXT_TAXONOMY)
