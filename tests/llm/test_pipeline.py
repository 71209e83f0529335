import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import rows_of
from diamondlake.llm.catalog import QUERIES
from diamondlake.llm.decontaminate import question_and_answer
from diamondlake.llm.oracles import ORACLES
from tests.llm.helpers import FOLD, words
from tests.llm.test_near_and_leaks import components, shingles

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@tables
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    quality = {r.doc_id: r.predicted for r in QUERIES["op3_quality"](spark, FOLDER).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
            kept = {r.doc_id: r for r in docs.collect()}
            assert all(before[i] == r for i, r in kept.items()) and docs.count() == len(kept)
        if k == 0:
            assert set(kept) == {i for i in before if quality[i] == 1}
        elif k == 1:
            last = {}
            for i in sorted(before):
                last[before[i].text] = i
            assert set(kept) == set(last.values())
        elif k == 2:
            want = components([(i, r.text) for i, r in before.items()])
            assert set(kept) == {i for i in before if want[i][1] == i}
        elif k == 3:
            leaks = set()
            for i, r in before.items():
                here, w = shingles(r.text), set(words(r.text.translate(FOLD)))
                for item in items:
                    of = shingles(item.text)
                    answer = set(question_and_answer(item.text.translate(FOLD))[1])
                    if len(of & here) >= .75 * len(of) and len(answer & w) >= .5 * len(answer):
                        leaks.add(i)
            assert set(kept) == set(before) - leaks
        else:
            assert docs.columns == COLUMNS + ["copy"]
            rows = docs.collect()
            assert all(tuple(r)[:5] == tuple(before[r.doc_id]) for r in rows)
            total = sum(len(words(r.text)) for r in before.values())
            assert sum(len(words(r.text)) for r in rows) == pytest.approx(total, rel=0.15)
            run = corpus_pipeline.run(spark, FOLDER)
            assert sorted(map(tuple, run.collect())) == sorted(map(tuple, rows))


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df, result = QUERIES[name](spark, FOLDER), con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), names)


def test_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if k.startswith("op")} - {"op"}
    assert found["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


def test_exact_stage_drops_rows_not_ids(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (7, None), (8, ""), (None, "A"), (None, "C"), (4, "D"), (4, "D")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    got = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert got.columns == COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [
        (0, "A"), (0, "C"), (4, "D"), (4, "D"), (5, "B"), (8, ""), (9, "A")]


def test_exact_stage_moves_the_texts_once_to_judge_them(spark):
    """The filter on kept rows went below the joins, so that each of two branches moved all texts."""
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string")
    got = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert "_head" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in got.collect()) == list(range(33, 40))


def test_empty_tables_pass(spark, tmp_path):
    for t, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                      ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@tables
@pytest.mark.parametrize("k", range(5))
def test_extra_columns_of_any_name_come_through(spark, k):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["predicted", "_text", "_words", "_id", "_digest", "id", "digest", "row", "copy", "score"]
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    out = corpus_pipeline.STAGES[k][1](spark, docs, FOLDER)
    assert out.columns == docs.columns + (["copy_"] if k == 4 else [])
    for r in out.collect():
        assert all(r[n] == f"{n} of {r.doc_id}" for n in names)
