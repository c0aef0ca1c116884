"""The corpus pipeline: from raw documents to a mixed training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``; the last returns the mix: doc_id, source, size, source_size,
target, taken (words).

Every stage accepts nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns, with the results that its operator defines: documents
without a letter (null and empty texts too) leave in the first stage.  Every row is
decided by itself, whatever its doc_id: rows that share a doc_id, or have none, are
documents of their own, and only rows equal in doc_id and text are one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from zonelens.llm.common import fresh_folder, table
from zonelens.llm.decontaminate import drop_leaks
from zonelens.llm.exact_dedup import drop_exact_copies
from zonelens.llm.language_id import drop_unknown_language
from zonelens.llm.mixing import mix
from zonelens.llm.ngram_join import drop_near_copies
from zonelens.session import remove_work, work_folders

#: Work folders that the last stage has left, as its result reads from them.
_left: list[str] = []


def _after_the_last(stage):
    """A stage that first removes what the stage before has left: its result is written
    by now.  Folders that ``docs`` reads from stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = {part for path in docs.inputFiles() for part in path.split("/")}
            remove_work(spark, [f for f in _left if f.rsplit("/", 1)[1] not in read])
            _left.clear()
        before = set(work_folders(spark))
        out = stage(spark, docs, sf_dir)
        _left.extend(f for f in work_folders(spark) if f not in before)
        return out

    return run_stage


@_after_the_last
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents whose language cannot be told go."""
    return drop_unknown_language(docs)


@_after_the_last
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of equal contents stays."""
    return drop_exact_copies(docs)


@_after_the_last
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each component of near copies stays."""
    return drop_near_copies(docs)


@_after_the_last
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a test item of ``benchmark`` go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@_after_the_last
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what the mix takes of each document."""
    return mix(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mix", mixture)]

#: Language identification, alignment and the join cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        out = fresh_folder(spark, f"pipeline-{name}")
        done.write.parquet(out)
        docs = spark.read.parquet(out)
        remove_work(spark, last + _left)
        last = [out]
    return docs
