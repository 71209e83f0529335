import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from diamondlake.operators import boosting, folds, forests, models


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x, z = rng.randrange(12) / 4, rng.choice([None, -2.0, -1.0, 0.5, 1.0, 3.0])
        win = float(rng.random() < 1 / (1 + np.exp(1.5 - x + (z or -1.0) * x)))
        rows.append((i, dt.date(2026, 4, 1) + dt.timedelta(days=i // 8), win, int(9 + 3 * x + rng.randrange(4)), x, z,
                     rng.gauss(0, 1), None))
    return spark.createDataFrame(rows, "game_pk long, game_date date, home_win double, total_runs int, x double, "
                                       "z double, wide double, empty double").cache()


ALL = dict(subsample=1.0, share=1.0)


def fitted(games, features, label, **rules):
    train = games.where(F.col(label).isNotNull())
    ens = models.input_stats(train, features)
    rows = forests.binned(train, features, ens.medians, label, train.count())
    try:
        return ens, rows, forests.Boosted(forests.Rules(**rules)).fit(rows)
    finally:
        rows.unpersist()


def column(df, *by):
    return np.array([r[0] for r in df.orderBy("game_pk").select(*by).collect()])


def mllib(games, ens, algo, label, out):
    data = models.vectors(games, ens).withColumn("_label", F.col(label).cast("double"))
    return column(algo.fit(data.coalesce(1)).transform(data), out)


@pytest.mark.parametrize("depth, rounds", [(1, 1), (3, 6), (5, 12)])
def test_same_as_mllib_where_nothing_is_drawn(spark, games, depth, rounds):
    features = ["x", "z", "empty"]
    common = dict(featuresCol="_tree", labelCol="_label", maxIter=rounds, maxDepth=depth, stepSize=0.1)
    rules = dict(rounds=rounds, depth=depth, rate=0.1, **ALL)
    ens, _, forest = fitted(games, features, "home_win", **rules)
    want = mllib(games, ens, GBTClassifier(**common), "home_win", vector_to_array("probability")[1])
    assert column(games, forests.predicted(games, forest)) == pytest.approx(want, abs=1e-6)
    ens, _, forest = fitted(games, features, "total_runs", loss="squared", **rules)
    want = mllib(games, ens, GBTRegressor(**common), "total_runs", "prediction")
    assert column(games, forests.predicted(games, forest)) == pytest.approx(want, abs=1e-5)


def test_arrays_score_as_the_expression(spark, games):
    _, _, forest = fitted(games, ["x", "z", "wide"], "home_win", rounds=4, depth=3)
    assert any(n.feature == "z" for tree in forest.trees for n in tree.values())
    assert column(games, forests.predicted(games, forest)) == pytest.approx(column(games, forest.prediction()), abs=1e-12)
    stump = boosting.Forest(0.2, [{1: boosting.Node(0.0, "z", None), 2: boosting.Node(1.0), 3: boosting.Node(-1.0)}])
    assert column(games, forests.predicted(games, stump)) == pytest.approx(column(games, stump.prediction()))


@pytest.mark.parametrize("loss, label", [("logistic", "home_win"), ("squared", "total_runs")])
def test_jobs_over_many_tasks_grow_the_trees_of_one_task(spark, games, monkeypatch, loss, label):
    rules = dict(rounds=5, depth=3, loss=loss, subsample=1.0, share=0.8)
    _, rows, here = fitted(games, ["x", "z", "wide"], label, **rules)
    assert rows.dealt.getNumPartitions() == 1
    monkeypatch.setattr(forests, "ROWS_IN_TASK", 50)
    monkeypatch.setattr(forests, "ROWS_A_TASK", 30)
    _, rows, dealt = fitted(games, ["x", "z", "wide"], label, **rules)
    assert rows.dealt.getNumPartitions() == 14
    assert len(here.trees) == len(dealt.trees) == 5
    assert column(games, forests.predicted(games, here)) == pytest.approx(
        column(games, forests.predicted(games, dealt)), abs=1e-6)


def test_lost_margins_are_made_again(spark, games, monkeypatch):
    monkeypatch.setattr(forests, "ROWS_IN_TASK", 50)
    rules = dict(rounds=4, depth=2)
    _, _, whole = fitted(games, ["x", "z"], "home_win", **rules)
    plain = forests.split_level
    seen = []

    def losing(*args):
        seen.append(1)
        if len(seen) == 6:          # within the third round: all kept blocks go
            for r in spark.sparkContext._jsc.getPersistentRDDs().values():
                r.unpersist(True)
        return plain(*args)

    monkeypatch.setattr(forests, "split_level", losing)
    assert fitted(games, ["x", "z"], "home_win", **rules)[2] == whole


def test_blocks_and_pairs_sum_as_rows(monkeypatch):
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 33, (3, 500)).astype(np.uint8), rng.normal(size=500)
    rules = forests.Rules(loss="squared", subsample=0.7)
    found = []
    for paired in (10_000, 1):
        monkeypatch.setattr(forests, "PAIRED", paired)
        b = forests.Block((0, 0), bins, y, rules)
        b.begin(0)
        b.node[:] = np.arange(500) % 4
        found.append(b.sums(4))
    drawn = b.weight != 0
    assert 300 < drawn.sum() < 400
    want = np.zeros((4, 3, 33, 2))
    for i in np.flatnonzero(drawn):
        for f in range(3):
            want[i % 4, f, bins[f, i]] += 1, y[i]
    for got in found:
        assert (got[..., 0] == want[..., 0]).all() and got[..., 1] == pytest.approx(want[..., 1], abs=1e-7)


def test_cuts_of_frames_and_arrays_are_the_same(spark, games):
    names = ["x", "z", "wide", "empty"]
    pdf = games.toPandas()
    got = forests.cuts_in(games.repartition(7), names)
    for f in names:
        assert got[f] == pytest.approx(forests.cuts_of(pdf[f].to_numpy(float)), abs=1e-9)
    assert got["empty"] == [] and len(got["x"]) == 11 and len(got["wide"]) == 31


def jobs_of(spark, call):
    group = f"group-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        call()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_of_few_rows_take_no_jobs(spark, games):
    """Before, every level of every round was a job."""
    for rounds in (2, 40):
        s = models.Settings(members=("boosted_a", "boosted_b"), rounds=rounds, depth=3)
        train = games.withColumns({"home_score": F.col("total_runs"), "away_score": F.lit(12)})
        assert jobs_of(spark, lambda: models.totals_head(train, train, ["x", "z"], s)[0].count()) < 40
        assert jobs_of(spark, lambda: models.run_line_head(train, train, ["x", "z"], s)[0].count()) < 40


def test_all_folds_are_trained_in_one_job_and_as_fit_does(spark, games, monkeypatch):
    s = models.Settings(rounds=4, depth=2, subsample=1.0)
    table = folds.fold_table(games, cadence=3).collect()
    assert len(table) > 10
    fit = models.fit
    with monkeypatch.context() as m:
        m.setattr(models, "fit", None)
        oof = models.walk_forward(games, ["x", "z", "wide"], s, cadence=3).cache()
    assert oof.columns == [*games.columns, "p_boosted_a", "p_boosted_b", "p_logistic", "home_win_prob_model", "fold_idx"]
    assert {r["fold_idx"]: r["count"] for r in oof.groupBy("fold_idx").count().collect()} == {
        f["fold_idx"]: f["n_val"] for f in table}
    for f in (table[0], table[7]):
        ens = fit(folds.training_rows(games, f["val_start"]), ["x", "z", "wide"], s)
        want = models.member_probabilities(ens, folds.validation_rows(games, f["val_start"], f["val_end"]))
        for p in ("p_boosted_a", "p_boosted_b", "p_logistic", "home_win_prob_model"):
            assert column(oof.where(F.col("fold_idx") == f["fold_idx"]), p) == pytest.approx(column(want, p), abs=1e-4)
    # folds beyond a task go by jobs, with the same columns
    monkeypatch.setattr(forests, "ROWS_IN_TASK", 330)
    both = models.walk_forward(games, ["x", "z", "wide"], models.Settings(rounds=1, depth=1), cadence=15)
    assert both.columns == oof.columns and both.count() == 400 - 120 and both.groupBy("fold_idx").count().count() == 3


def test_repeated_and_null_keys_keep_their_rows(spark, games):
    odd = games.withColumn("game_pk", F.expr("case when game_pk % 3 > 0 then game_pk div 9 end"))
    oof = models.walk_forward(odd, ["x", "z"], models.Settings(rounds=2, depth=2), cadence=10)
    assert oof.count() == 400 - 80 and oof.where("game_pk is null").count() > 100


def test_one_label_only_gives_an_infinite_intercept():
    z = np.random.default_rng(0).normal(size=(30, 2))
    assert models.unit_penalty_weights(z, np.ones(30)).tolist() == [0, 0, np.inf]
    w = models.unit_penalty_weights(z, (z[:, 0] > 0).astype(float))
    p = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    slope = z.T @ (p - (z[:, 0] > 0)) + w[:-1]
    assert np.abs(slope).max() < 1e-7


def test_cuts_of_many_values_are_the_exact_quantiles(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr(
        "cast(id * id % 977 as double) as a", "cast(case when id % 3 = 0 then id div 20 else 5 end as double) as b",
        "case when id % 2 = 0 then id / 7 end as c")
    assert forests.inner_quantiles(df, ["a", "b", "c"]) == {
        f: pytest.approx(cuts) for f, cuts in boosting.cut_points(df, ["a", "b", "c"]).items()}
