"""The pipeline against its stages done by hand, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from zonelens.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_hand(spark):
    from test_dedup import components_by_hand, exact_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lang = {r["doc_id"] for r in QUERIES["op2_ppm"](spark, SF).collect() if r["lang_pred"] != "und" and r["bits_per_byte"] <= 8}
    assert lang <= {d for d, t in rows if t and any(map(str.isalpha, t))}
    rows = [r for r in rows if r[0] in lang]
    kept = {r[0] for r in exact_by_hand(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {r[2] for r in components_by_hand(rows)}
    rows = [r for r in rows if r[0] in kept]
    leaks = {r["doc_id"] for r in QUERIES["op3_rare_seeds"](spark, SF).collect()}
    expected = {r[0] for r in rows} - leaks
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(expected)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=25)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, make_docs, odd_rows, clashing, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for rows in (odd_rows, []):
        docs = make_docs(rows, clashing)
        out = run(spark, docs, SF)
        out.count()
        assert name == "mix" or out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    exp = con.execute(ORACLES[name]).df()
    cols = sorted(exp.columns)
    assert sorted(got.columns) == cols
    text = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
                                   for v in r) for r in df[cols].astype(object).itertuples(index=False))
    for c in cols:
        if got[c].dtype.kind == "f" or exp[c].dtype.kind == "f":
            got[c], exp[c] = got[c].astype(float), exp[c].astype(float)
    assert text(got) == text(exp)


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_copies_are_decided_row_by_row(spark, make_docs, stage):
    texts = [" ".join(f"{w}{i}" for i in range(9)) for w in ("alpha", "beta", "gamma")]
    long = texts[2] + " and some words more"
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (0, long), (1, long), (1, texts[2]), (1, texts[2]), (2, texts[1])]
    got = dict(corpus_pipeline.STAGES)[stage](spark, make_docs(rows, ("kept",)), SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted(
        [("None", texts[0]), ("2", texts[1]), ("0", long), ("1", texts[2])])


def test_leaks_leave_row_by_row(spark, make_docs):
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = "nothing that any test item holds"
    rows = [(None, item), (None, clean), (1, item), (1, clean), (2, clean)]
    got = dict(corpus_pipeline.STAGES)["decontaminate"](spark, make_docs(rows), SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", clean), ("2", clean), ("None", clean)]
