"""Every registered query against its DuckDB statement on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of
from diamondlake.operators import folds
from diamondlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
QUERIES = {k: entry.queries()[k] for k in catalog.QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), names)


def test_only_fitted_models_lack_a_statement():
    assert set(QUERIES) - set(ORACLES) == {
        "walk_forward_predictions", "member_roster", "linear_attributions", "totals_predictions",
        "run_line_predictions"}


@pytest.mark.parametrize("name", ["walk_forward_predictions", "member_roster"])
def test_walk_forward_queries_score_every_fold(spark, monkeypatch, name):
    seen = []

    def scored(games, features, **options):
        seen.append(folds.fold_table(games, **options).count())
        return games.selectExpr("*", "0 as fold_idx", *[f"0.5 as {c}" for c in (
            "p_boosted_a", "p_boosted_b", "p_logistic", "home_win_prob_model")])

    monkeypatch.setattr(catalog.models, "walk_forward", scored)
    QUERIES[name](spark, FOLDER)
    dates = spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderstatus in ('F', 'O')").select(
        "o_orderdate").distinct().count()
    assert seen == [-(-(dates - 7) // 7)] and seen[0] > 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
