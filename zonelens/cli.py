"""Batch jobs on real input files, one subcommand per reference job.

    spark-submit zonelens/cli.py compact      --obs 'raw/2017-11-*/*.json.gz' --out compact/
    spark-submit zonelens/cli.py grouped      --obs ... --out grouped/
    spark-submit zonelens/cli.py convert      --obs ... --out json/
    spark-submit zonelens/cli.py features     --rankings 'ranks/*_2017-11-01.csv' --obs ... --out f/
    spark-submit zonelens/cli.py correlation  --rankings ... --obs ... --out corr/ [--day ...]
    spark-submit zonelens/cli.py rank-stats   --rankings 'ranks/*' --out stats/
    spark-submit zonelens/cli.py top          --rankings 'ranks/*' --out top/ [--n 100 --exclude google]
    spark-submit zonelens/cli.py names        --stats stats/ --out names/ [--limit 100000]
    spark-submit zonelens/cli.py lengths      --stats stats/ --out lengths/
    spark-submit zonelens/cli.py length-rank  --stats stats/ --out lr/ [--limit 1000]
    spark-submit zonelens/cli.py entropy      --stats stats/ --out entropy/
    spark-submit zonelens/cli.py random-names --stats stats/ --out bands/
    spark-submit zonelens/cli.py txt          --obs ... --out txt/ [--day 20171101 ...]
    spark-submit zonelens/cli.py soa          --obs ... --out soa/ [--day ...]
    spark-submit zonelens/cli.py qtypes       --obs ... --out qtypes/ [--day ...]
    spark-submit zonelens/cli.py random-samples --stats stats/ --out samples/ [--n 5]
    spark-submit zonelens/cli.py registrable  --obs ... --rules public_suffix_list.dat --out reg/
    spark-submit zonelens/cli.py trajectories --rankings ... --names names.txt --out paths/
    spark-submit zonelens/cli.py qtype-months --obs ... --out months/
    spark-submit zonelens/cli.py txt-months   --obs ... --out months/
    spark-submit zonelens/cli.py txt-shares   --obs ... --out shares/
    spark-submit zonelens/cli.py audit        --obs raw/ --rankings 'ranks/*' --out audit/

``--day`` (repeatable, ``yyyy[MM[dd]]``) selects days inside one job (the day is a
grouping key) instead of one job per day: on observations as a range of the raw
timestamp, which reaches the scan, and on rankings by the day of the file name.
Outputs are Parquet unless ``--csv`` is given (headerless CSV, as the reference
wrote); ``compact``, ``grouped`` and ``convert`` write gzip JSON lines.  ``txt`` writes
the sensitive rows beside its counts (``<out>.sensitive``).

Every job over raw input also writes what it had to leave out, by reason, to
``<out>.rejected`` (malformed lines, missing required fields, ranks that are no
numbers, ...).  Observations are read once: accepted rows go to Parquet by day in a work
folder, which the job reads, and rejected lines to ``<out>.quarantine`` with their reasons.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from zonelens.operators import querytypes as QT  # noqa: E402
from zonelens.operators import rankings as R  # noqa: E402
from zonelens.operators import records as REC  # noqa: E402
from zonelens.operators import stats as S  # noqa: E402
from zonelens.operators import suffix as SUF  # noqa: E402
from zonelens.operators import txt as T  # noqa: E402
from zonelens.plans import jobs as J  # noqa: E402
from zonelens.session import remove_work, work_folder, work_folders  # noqa: E402
from zonelens.sources import readers as RD  # noqa: E402
from zonelens.sources import sinks as SK  # noqa: E402

JOBS = ("compact", "grouped", "convert", "features", "correlation", "rank-stats", "top", "names", "lengths",
        "length-rank", "entropy", "random-names", "random-samples", "txt", "soa", "qtypes", "registrable", "trajectories",
        "qtype-months", "txt-months", "txt-shares", "audit")


class Inputs:
    """The inputs of one job, read when first used, and their reject counts."""

    def __init__(self, spark: SparkSession, args) -> None:
        self.spark, self.args, self.rejects, self.ingested = spark, args, [], None

    def observations(self) -> DataFrame:
        """The accepted observations: the raw lines are read once, however often this
        is used, and rejected ones are counted and kept in the same pass."""
        if self.ingested is None:
            self.ingested = RD.ingest_observations(self.spark, self.args.obs, work_folder(self.spark, "ingested"), self.args.day)
            self.rejects.append(self.ingested.counts)
        return self.ingested.accepted

    def raw_observations(self) -> DataFrame:
        return self.observations().drop("day")

    def rankings(self) -> DataFrame:
        lines = RD.read_rank_lines(self.spark, self.args.rankings)
        self.rejects.append(RD.rejected_rank_lines(lines))
        ranks = RD.parse_rank_lines(lines)
        return RD.filter_days(ranks, self.args.day) if self.args.day else ranks

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(self.args.stats)


def audit(inputs: Inputs) -> DataFrame:
    """Per day of the rankings, the observation files found for it (the day is
    the eight digits of the folder name)."""
    files = RD.list_files(inputs.spark, inputs.args.obs[0]).select(
        F.try_to_date(F.regexp_extract("path", r"/(\d{8})/[^/]*$", 1), "yyyyMMdd").alias("day"), F.col("path").alias("file_name"))
    return RD.audit_days(inputs.rankings().select("day"), files, inputs.args.files)


def result(job: str, x: Inputs) -> DataFrame:
    a = x.args
    if job == "compact":
        return REC.compact_records(x.observations())
    if job == "grouped":
        return REC.group_records(x.raw_observations(), nested=True)
    if job == "features":
        return J.day_features(x.rankings(), x.observations())
    if job == "correlation":
        return J.rank_record_correlation(x.rankings(), x.observations())
    if job == "rank-stats":
        return R.rank_stats(x.rankings())
    if job == "top":
        return R.top_n_per_day(x.rankings(), a.n, a.exclude)
    if job == "names":
        return R.name_features(x.stats(), a.limit or 100_000)
    if job == "lengths":
        return R.length_histogram(x.stats())
    if job == "length-rank":
        return R.length_vs_rank(x.stats(), a.limit or 1000)
    if job == "entropy":
        return R.domain_entropy(x.stats())
    if job == "random-names":
        return J.random_name_bands(R.domain_entropy(x.stats()))
    if job == "txt":
        return J.txt_report(x.observations())
    if job == "soa":
        return J.soa_report(x.observations())
    if job == "qtypes":
        return QT.query_type_counts(x.observations())
    if job == "random-samples":
        return S.sample_bands(R.domain_entropy(x.stats()), J.ENTROPY_BANDS, a.n)
    if job == "registrable":
        rules = x.spark.read.text(a.rules).select(F.split(F.trim("value"), r"\s+")[0].alias("rule"))
        return SUF.group_by_registrable(x.observations(), rules.where("rule <> '' AND NOT startswith(rule, '//')"))
    if job == "trajectories":
        ranks = x.rankings().where("rank IS NOT NULL").select("domain", F.col("rank").alias("alexa_rank"), F.date_format("day", "yyyyMMdd").alias("date"))
        return R.trajectory(ranks, x.spark.read.text(a.names).select(F.trim("value").alias("domain")).distinct())
    if job == "qtype-months":
        counts = QT.query_type_counts(x.observations()).withColumnRenamed("count", "n")
        return T.month_pivot(counts, QT.PLOTTED_QUERY_TYPES, label_col="query_type")
    if job == "txt-months":
        counts = T.txt_label_counts(x.observations()).withColumn("category", T.category_of("label"))
        return T.month_pivot(counts, dict.fromkeys(label.partition(".")[0] for label in T.label_names()), label_col="category")
    if job == "txt-shares":
        return T.txt_shares(x.observations())
    return audit(x)


def _write(df: DataFrame, path: str, csv: bool) -> None:
    if csv:
        SK.write_csv(df, path, compression="gzip")
    else:
        df.write.mode("overwrite").parquet(path)


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Runs one job; returns its result as read from what it wrote."""
    p = argparse.ArgumentParser(prog="zonelens")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in JOBS:
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        s.add_argument("--csv", action="store_true")
        s.add_argument("--obs", nargs="*")
        s.add_argument("--rankings", nargs="*")
        s.add_argument("--stats")
        s.add_argument("--rules")
        s.add_argument("--names")
        s.add_argument("--day", action="append")
        s.add_argument("--limit", type=int)
        s.add_argument("--n", type=int, default=100)
        s.add_argument("--exclude", default="google")
        s.add_argument("--files", type=int, default=11)
    args = p.parse_args(argv)
    if args.csv and args.cmd in ("compact", "grouped", "convert"):
        raise SystemExit(f"{args.cmd} writes gzip JSON lines; drop --csv")
    inputs, before = Inputs(spark, args), set(work_folders(spark))
    out_path = args.out.rstrip("/")
    if args.cmd == "convert":
        SK.convert_raw(inputs.raw_observations(), out_path)
        written = spark.read.text(out_path)
    else:
        out = result(args.cmd, inputs)
        if args.cmd in ("compact", "grouped"):
            SK.write_records(out, out_path)
            written = spark.read.schema(out.schema).json(out_path)
        else:
            _write(out, out_path, args.csv)
            written = spark.read.schema(out.schema).csv(out_path) if args.csv else spark.read.parquet(out_path)
        if args.cmd == "txt":
            _write(J.txt_sensitive(inputs.observations()), f"{out_path}.sensitive", args.csv)
    if inputs.rejects:
        table = inputs.rejects[0]
        for more in inputs.rejects[1:]:
            table = table.unionByName(more)
        table.write.mode("overwrite").json(f"{out_path}.rejected")
    if inputs.ingested is not None:
        inputs.ingested.quarantine.write.mode("overwrite").option("compression", "gzip").json(f"{out_path}.quarantine")
    remove_work(spark, [f for f in work_folders(spark) if f not in before])
    return written


def main(argv: list[str] | None = None) -> None:
    from zonelens.session import get_session
    spark = SparkSession.getActiveSession() or get_session(master=os.environ.get("ZONELENS_MASTER"))
    run(spark, sys.argv[1:] if argv is None else argv)


if __name__ == "__main__":
    main()
