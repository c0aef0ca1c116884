import gzip
import json
import os

from pyspark.sql import functions as F

from zonelens.operators import querytypes as QT
from zonelens.operators import soa as SOA
from zonelens.operators import txt as T
from zonelens.streaming import daily


def _write_day_files(root, fx):
    rows = [r.asDict() for r in fx.observations.drop("event_id", "day").collect()]
    os.makedirs(root)
    for i in range(4):
        with gzip.open(os.path.join(root, f"part-{i}.json.gz"), "wt") as f:
            for r in rows[i::4]:
                f.write(json.dumps({k: v for k, v in r.items() if v is not None}) + "\n")


def test_streaming_daily_counts_match_batch(spark, scratch, fx):
    src = os.path.join(scratch, "in")
    _write_day_files(src, fx)
    stream = daily.observation_stream(spark, src, files_per_trigger=2)
    q1 = daily.start(daily.daily_query_types(stream, "0 seconds"), "qt_test", sink="memory",
                     checkpoint=os.path.join(scratch, "ck1"), available_now=True)
    q2 = daily.start(daily.daily_soa(stream, "0 seconds"), "soa_test", sink="memory",
                     checkpoint=os.path.join(scratch, "ck2"), available_now=True)
    q3 = daily.start(daily.daily_txt_labels(stream, "0 seconds"), "lab_test", sink="memory",
                     checkpoint=os.path.join(scratch, "ck3"), available_now=True)
    q4 = daily.start(daily.daily_txt_basic(stream, "0 seconds"), "basic_test", sink="memory",
                     checkpoint=os.path.join(scratch, "ck4"), available_now=True)
    for q in (q1, q2, q3, q4):
        q.awaitTermination()
    batch = QT.query_type_counts(fx.observations)
    got = spark.sql("SELECT * FROM qt_test")
    # append mode emits a day once the watermark passes it: every day but the last
    last = batch.agg(F.max("day")).first()[0]
    exp = {(str(r.day), r.query_type): r["count"] for r in batch.filter(F.col("day") < last).collect()}
    assert {(str(r.day), r.query_type): r["count"] for r in got.collect()} == exp
    soa_exp = {str(r.day): r.in_range_retry for r in SOA.soa_ranges(fx.observations)
               .filter(F.col("day") < last).collect()}
    assert {str(r.day): r.in_range_retry for r in spark.sql("SELECT * FROM soa_test").collect()} == soa_exp
    lab = T.txt_label_counts(fx.observations).filter(F.col("day") < last)
    assert {(str(r.day), r.label): r.n for r in lab.collect()} == \
        {(str(r.day), r.label): r.n for r in spark.sql("SELECT * FROM lab_test").collect()}
    basic = T.txt_basic(fx.observations).filter(F.col("day") < last)
    assert {str(r.day): (r.total, r.txt, r.correct_txt) for r in basic.collect()} == \
        {str(r.day): (r.total, r.txt, r.correct_txt) for r in spark.sql("SELECT * FROM basic_test").collect()}
