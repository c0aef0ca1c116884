"""Statistics and ordered reports.

Scale notes
-----------
* correlation matrices take co-moments per null pattern, in blocks of half the
  columns, with partial sums map-side.
* exact quartiles never gather a column in one task: places are selected by counting
  leading bits (``order.radix_select``).
* heads (``top_k``/``bottom_above``) are ``TakeOrderedAndProject``: each task
  keeps k rows, the driver merges k x tasks rows.
"""

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.functions.names import round2
from zonelens.operators.order import radix_select, stored
from zonelens.session import scratch


def entropy_histogram(df: DataFrame, col: str = "entropy", key: str = "domain") -> DataFrame:
    """Number of names per entropy rounded to two digits."""
    return (df.groupBy(round2(col).alias("entropy_rnd"))
              .agg(F.count(key).alias("domain_count")))


def entropy_band(df: DataFrame, lo=None, hi=None, lo_closed: bool = False,
                 hi_closed: bool = False, col: str = "entropy") -> DataFrame:
    """Rows with the value inside a band (open/closed ends); pushed to
    the Parquet scan when read from files."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= lo) if lo_closed else (c > lo))
    if hi is not None:
        cond = cond & ((c <= hi) if hi_closed else (c < hi))
    return df.filter(cond)


def top_k(df: DataFrame, col: str, k: int, tie: str | None = None,
          ascending: bool = False) -> DataFrame:
    """sort by ``col`` (descending by default) with a tie-break, head k."""
    key = F.col(col).asc() if ascending else F.col(col).desc()
    order = [key] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(k)


def bottom_above(df: DataFrame, col: str, lo: float, k: int = 20,
                 tie: str | None = None) -> DataFrame:
    """rows with ``col > lo``, the ``k`` smallest."""
    return top_k(df.filter(F.col(col) > lo), col, k, tie, ascending=True)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """repeatable sample of n rows: the n smallest seeded hashes of the
    key (``md5`` of ``seed:key``, so any engine can reproduce the sample).
    A ``TakeOrderedAndProject``: each task keeps n rows."""
    k = F.col(key).cast("string") if key else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    h = F.md5(F.concat(F.lit(f"{seed}:"), k))
    return df.withColumn("_h", h).orderBy("_h", *([key] if key else [])).limit(n).drop("_h")


def sample_bands(df: DataFrame, bands: dict, n: int, seed: int = 42, key: str = "domain", col: str = "entropy") -> DataFrame:
    """F4 over many bands (name -> (lo, hi, lo_closed, hi_closed), B27) in one pass: the n
    rows of least seeded hash of each band, as (band, *columns).  A row counts for every
    band it lies in; each task keeps n rows a band before the shuffle (WindowGroupLimit)."""
    c, marks = F.col(col), []
    for name, (lo, hi, lo_closed, hi_closed) in bands.items():
        cond = (c >= lo) if lo_closed else (c > lo)
        if hi is not None:
            cond = cond & ((c <= hi) if hi_closed else (c < hi))
        marks.append(F.when(cond, F.lit(name)))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("band"), "*", h.alias("_h"))
    w = Window.partitionBy("band").orderBy("_h", key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_h", "_n")


def preview(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """first n rows after a total order (when given)."""
    return (df.orderBy(*order) if order else df).limit(n)


def rows_at(df: DataFrame, key: str, values: list) -> DataFrame:
    """F7 (re-aimed): rows by a key list; row positions are not stable in Spark."""
    return df.filter(F.col(key).isin(values))


def column_profile(df: DataFrame, col: str) -> DataFrame:
    """Rows, non-null values, exact distinct count, min and max."""
    c = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"),
                  F.countDistinct(c).alias("distinct"), F.min(c).alias("min"),
                  F.max(c).alias("max"))


def removed_count(df: DataFrame, cond) -> DataFrame:
    """How many rows a filter removes."""
    return df.agg(F.count_if(cond).alias("removed"), F.count(F.lit(1)).alias("rows"))


def exact_quantiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas, ``quantile_cont``): one row
    (p, value) per probability; value is null for a column without values.

    The column alone is written to the shared folder, 8 bytes a value, and
    ``order.radix_select`` finds the wanted places in it: at most four passes of a
    grouped count, the same at every size.  The result is one row of plain numbers per
    probability."""
    with scratch(df.sparkSession):
        v = stored(df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL"), "quantiles")
        return _quantile_rows(v, probs)


def _quantile_rows(values: DataFrame, probs) -> DataFrame:
    n, ends = radix_select(values, probs)
    rows = []
    for p, at in zip(probs, ends):
        frac = p * (n - 1) - math.floor(p * (n - 1)) if n else 0.0
        rows.append((float(p), None if at is None else at[0] if at[0] == at[1] else at[0] + (at[1] - at[0]) * frac))
    return values.sparkSession.createDataFrame(rows, "p double, value double")


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of one column.

    The column is computed once and written alone; the moments are one ordinary
    aggregate over it, the quartiles come from ``radix_select``, and the copy is removed."""
    with scratch(df.sparkSession):
        v = stored(df.select(F.col(col).cast("double").alias("v")), "describe")
        c = F.col("v")
        n, mean, std, least, most = v.agg(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).first()
        quartiles = [r["value"] for r in _quantile_rows(v, (0.25, 0.5, 0.75)).collect()]
    return df.sparkSession.createDataFrame([(n, mean, std, least, *quartiles, most)], "count long, mean double, std double, "
                                           "min double, q25 double, q50 double, q75 double, max double")


def correlation_matrix(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson r for every column pair (a < b in list order), long form
    (``by``..., a, b, r).  Rows where either value is null do not count for that
    pair; a constant column gives null, not an error.

    Rows are grouped by which of the columns are null, so that one count, mean and variance
    per column serve all pairs of a group.  Each row becomes one small row per column with
    the next half of the columns beside it (in a circle, so every pair is met once), and one
    aggregate with partial sums map-side takes the co-moments of a block: k rows of k / 2
    pairs instead of a row per pair.  What comes out has a row per (by, pattern, column);
    patterns are put together by their means, without sums of squares that cancel."""
    k, half = len(cols), len(cols) // 2
    keys = by
    by = tuple(f"__by{i}" for i in range(len(keys)))  # apart from the names used here
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, by)], *[F.col(f"`{c}`") for c in cols])
    pairs = {(i, j): n for n, (i, j) in enumerate((i, j) for i in range(k) for j in range(i + 1, k))}
    ends = {}  # pair number -> (column, distance)
    for i in range(k):
        for d in range(1, half + 1):
            ends.setdefault(pairs[min(i, (i + d) % k), max(i, (i + d) % k)], (i, d))
    pattern = " + ".join(f"CASE WHEN `{c}` IS NULL THEN {1 << i}L ELSE 0L END" for i, c in enumerate(cols))
    value = lambda i: f"CAST(`{cols[i % k]}` AS DOUBLE)"
    # one SQL expression string: a single call to build, however many columns
    items = ", ".join(f"named_struct('i', {i}, 'x', {value(i)}" + "".join(f", 'y{d}', {value(i + d)}" for d in range(1, half + 1)) + ")"
                      for i in range(k))
    blocks = (df.select(*by, F.expr(pattern).alias("__nulls"), F.expr(f"array({items})").alias("__b"))
                .select(*by, "__nulls", F.inline("__b")).where("x IS NOT NULL")
                .groupBy(*by, "__nulls", "i").agg(
                    F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"),
                    F.min("x").alias("lo"), F.max("x").alias("hi"),
                    F.array(*[F.covar_pop("x", f"y{d}") for d in range(1, half + 1)]).alias("c")))
    columns = blocks.groupBy(*by, "__nulls").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "m", "v", "c", "lo", "hi")))).alias("of"))
    each = ", ".join(f"named_struct('p', {p}, 'i', {i}, 'j', {(i + d) % k}, 'd', {d - 1})" for p, (i, d) in ends.items())
    both = columns.select(*by, F.inline(F.expr(
        f"transform(array({each}), q -> named_struct('p', q.p, 'x', of[q.i], 'y', of[q.j], 'c', of[q.i].c[q.d]))"))).where("x IS NOT NULL AND y IS NOT NULL")
    parts = both.groupBy(*by, "p").agg(F.collect_list(F.struct(
        F.col("x.n").alias("n"), F.col("x.m").alias("mx"), F.col("y.m").alias("my"), F.col("x.v").alias("vx"), F.col("y.v").alias("vy"), "c")).alias("g"),
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("x.m")).alias("sx"), F.sum(F.col("x.n") * F.col("y.m")).alias("sy"),
        *[f(F.col(f"{z}.{e}")).alias(z + e) for z in "xy" for f, e in ((F.min, "lo"), (F.max, "hi"))])
    total = lambda e: F.expr(f"aggregate(g, 0D, (s, t) -> s + t.n * ({e}))")
    r = F.try_divide(total("t.c + (t.mx - sx / n) * (t.my - sy / n)"),
                     F.sqrt(total("t.vx + (t.mx - sx / n) * (t.mx - sx / n)")) * F.sqrt(total("t.vy + (t.my - sy / n) * (t.my - sy / n)")))
    quoted = ["'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in cols]
    names = F.expr("array(" + ", ".join(f"named_struct('a', {quoted[i]}, 'b', {quoted[j]})" for i, j in pairs) + ")")
    varies = (F.col("xlo") < F.col("xhi")) & (F.col("ylo") < F.col("yhi"))  # means of a constant may differ in their last bit
    found = parts.select(*by, "p", F.when(varies, r).alias("r"))
    return found.select(*by, F.get(names, F.col("p")).alias("pair"), "r").select(
        *[F.col(n).alias(c) for c, n in zip(keys, by)], "pair.a", "pair.b", "r")


def _p_values():
    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_pvalue(x, m - 2) if x == x and x is not None else None for x, m in zip(t, n)], dtype="float64")

    return p_value


def point_biserial(df: DataFrame, flag: str, col: str) -> DataFrame:
    """Correlation of a 0/1 flag with a value over the rows that have both,
    its t statistic, the number of these rows, and the two-sided p-value of
    Student's t with n - 2 degrees of freedom (evaluated on the one result row).
    """
    x, y = F.col(flag).cast("double"), F.col(col).cast("double")
    both = df.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    out = both.agg(r.alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return out.select("r", t.alias("t"), "n").withColumn("p", _p_values()("t", "n"))


def point_biserial_report(df: DataFrame, flag: str, col: str) -> dict:
    """D16 as the notebook reports it, as a dict of the one result row."""
    row = point_biserial(df, flag, col).first().asDict()
    return row | {"p": float("nan") if row["p"] is None else row["p"]}


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    if t == 0:
        return 1.0
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    lbeta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        ib = front * _betacf(a, b, x) / a
    else:
        ib = 1.0 - front * _betacf(b, a, 1.0 - x) / b
    return min(1.0, max(0.0, ib))
