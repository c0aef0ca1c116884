"""Global order without a global task: places in a total order (F6), ordered parts of
a group (secondary sort, D1/D3), exact quantiles by radix selection (D13).

Scale notes
-----------
* ``numbered`` range-partitions and sorts rows; only the sizes of the parts come to the
  driver, and a row's place is its part's offset plus its place in the part.
* ``ordered_parts`` cuts each group into parts of bounded length by these places, so a
  group of any size is written as many rows of at most that length.
* ``radix_select`` counts values by the leading bits of an order-preserving 64-bit key,
  keeps the ranges that hold a wanted place and looks at the next bits of these only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.session import work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read from there."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, *order: str, name: str = "numbered") -> DataFrame:
    """``rows`` and ``position`` (long): their place from 0 in the order of the columns
    ``order``, nulls first.  Rows equal in ``order`` are dealt out like others.  Written
    once to the shared folder: a place does not change when a task is repeated."""
    spark = rows.sparkSession
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.col("__row")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    within = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stored(within.drop("__row").withColumn("__at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for part_no, n in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((part_no, total))
        total += n
    begins = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))  # a row per part
    return placed.join(begins, part == F.col("__part")).withColumn("position", F.col("__start") + place).drop("__at", "__part", "__start")


def ordered_parts(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: Column, most: int = 1000) -> DataFrame:
    """(``by``..., part, values): the ``value`` of a group's rows in the order of
    ``order``, as parts 0, 1, ... of ``most`` values (the last one: fewer).

    A secondary sort: rows are placed by (``by``, ``order``) over all tasks, so no task
    and no row holds a whole group.  A null ``value`` is left out of the list and takes
    no place; a group of nothing else keeps one empty part 0."""
    flat = rows.select(*by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], value.alias("__v")).withColumn("__none", F.col("__v").isNull())
    placed = numbered(flat, *by, "__none", *[f"__o{i}" for i in range(len(order))], name="ordered-parts")
    first = placed.groupBy(*by).agg(F.min("position").alias("__first"))
    same = None
    for c in by:
        eq = F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
        same = eq if same is None else same & eq
    cut = placed.alias("p").join(first.alias("f"), same).select(
        *[F.col(f"p.{c}").alias(c) for c in by], F.col("__v"), (F.col("position") - F.col("__first")).alias("__at"))
    part = F.when(F.col("__v").isNull(), 0).otherwise(F.expr(f"__at div {most}")).cast("long")
    entry = F.when(F.col("__v").isNotNull(), F.struct("__at", "__v"))
    return cut.groupBy(*by, part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("__l")).select(
        *by, "part", F.transform("__l", lambda x: x["__v"]).alias("values"))


# ------------------------------------------------------------ radix selection

def ordered_key(v: str) -> str:
    """SQL: the double ``v`` (not null) as a long in the same order; -0.0 is 0.0, NaN
    the greatest.  Sign, exponent and fraction are taken out by exact powers of two."""
    a = f"abs({v})"
    e = f"least(1023, greatest(-1022, CAST(floor(log2({a})) AS INT)))"
    m = f"{a} * pow(2D, CAST(-({e}) AS DOUBLE))"  # the logarithm may be one too low or too high
    e = f"(CASE WHEN {m} >= 2D THEN {e} + 1 WHEN {m} < 1D THEN {e} - 1 ELSE {e} END)"
    m = f"{a} * pow(2D, CAST(-{e} AS DOUBLE))"
    normal = f"shiftleft(CAST({e} + 1023 AS BIGINT), 52) + CAST(({m} - 1D) * 4503599627370496D AS BIGINT)"
    small = f"CAST({a} * pow(2D, 1000D) * pow(2D, 74D) AS BIGINT)"
    bits = (f"(CASE WHEN {v} = 0D THEN 0L WHEN isnan({v}) THEN 9221120237041090560L WHEN {a} = DOUBLE('Infinity') THEN 9218868437227405312L "
            f"WHEN {a} < 2.2250738585072014E-308D THEN {small} ELSE {normal} END)")
    return f"(CASE WHEN {v} < 0D THEN -{bits} ELSE {bits} END)"


#: Bits that a pass counts by: the most rows a pass sends to the driver per wanted place.
RADIX_BITS = 16


def radix_select(values: DataFrame, probs) -> tuple[int, list[tuple[float, float] | None]]:
    """Number of the values ``v`` (doubles, nulls left out) and, per probability p, the
    values at the places floor and ceil of p * (n - 1) (None without values).

    At most four passes of one grouped count each; a pass counts only values that share
    their leading bits with a wanted place, and ends early where they are all equal."""
    keyed = values.where("v IS NOT NULL").select("v", F.expr(ordered_key("v")).alias("k"))
    found: dict[int, float] = {}
    open_: dict[int, list[int]] = {}  # leading bits -> wanted places, as (place, rank within)
    n, places, shift, inside = 0, [], 64, {}
    while shift == 64 or open_:
        shift -= RADIX_BITS
        part = keyed
        if open_:
            part = keyed.where(F.shiftright("k", shift + RADIX_BITS).isin(list(open_)))
        rows = sorted(part.groupBy(F.shiftright("k", shift).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
        if not n:
            n = sum(r["n"] for r in rows)
            if not n:
                return 0, [None for _ in probs]
            places = sorted({x for p in probs for x in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
            inside = {None: [(x, x) for x in places]}
        new: dict = {}
        for head, wanted in inside.items():
            below = 0
            for r in (r for r in rows if head is None or r["b"] >> RADIX_BITS == head):
                for place, rank in wanted:
                    if below <= rank < below + r["n"]:
                        if r["lo"] == r["hi"] or r["lo"] != r["lo"] or not shift:
                            found[place] = r["lo"]
                        else:
                            new.setdefault(r["b"], []).append((place, rank - below))
                below += r["n"]
        inside, open_ = new, new
    return n, [(found[math.floor(p * (n - 1))], found[math.ceil(p * (n - 1))]) for p in probs]
