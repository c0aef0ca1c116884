"""Replicated-scale run: events x K (``explode(sequence)``, ids shifted so
every copy is a distinct event on the same hosts and days) through the
fixture views, then D1 (compaction), J2 (rankings x record sets) and D7
(TXT labels).  Prints rows, seconds (full materialisation with the noop sink) and the
number of shuffle exchanges of each final plan, to show the work grows linearly with one shuffle per
aggregate/join side.

Usage: python scripts/scale_run.py [sf_dir] [K ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from zonelens.operators import records as REC  # noqa: E402
from zonelens.operators import txt as T  # noqa: E402
from zonelens.plans import jobs as J  # noqa: E402
from zonelens.plans.bindings import Fixture  # noqa: E402
from zonelens.session import get_session  # noqa: E402


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factors = [int(x) for x in sys.argv[2:]] or [1, 10]
    spark = get_session(shuffle_partitions=32)
    for k in factors:
        fx = Fixture(spark, sf_dir)
        ev = spark.read.parquet(f"{sf_dir}/events.parquet")
        span = ev.agg(F.max("event_id") + 1).first()[0]
        # spread the one-row-group source first, as a real multi-file input would be
        rep = (ev.repartition(4 * spark.sparkContext.defaultParallelism)
                 .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
                 .withColumn("event_id", F.col("event_id") + F.col("rep") * F.lit(span))
                 .drop("rep"))
        fx._cache["events"] = rep
        for name, df in (("d1_compact_records", REC.compact_records(fx.observations)),
                         ("j2_day_features", J.day_features(fx.rankings, fx.observations)),
                         ("d7_txt_label_counts", T.txt_label_counts(fx.observations))):
            # noop sink: every column is computed (count() would let Catalyst
            # prune the aggregated payload away)
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            n = df.count()
            print(f"x{k} {name}: rows={n} sec={dt:.2f} exchanges={exchanges(df)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
