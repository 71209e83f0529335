import collections
import datetime as dt
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.operators import folds, models
from diamondlake.plans import daily
from diamondlake.sources.landing import prepare_games

QUICK = models.Settings(rounds=2, depth=2)
LINEAR = models.Settings(members=("logistic",))


def test_weights_sum_to_one_and_renormalise():
    assert sum(models.member_weights(list(K.MEMBER_WEIGHTS)).values()) == pytest.approx(1.0)
    two = models.member_weights(["boosted_a", "logistic"])
    assert two == pytest.approx({"boosted_a": 2 / 3, "logistic": 1 / 3})
    assert models.member_weights(["unknown", "other"]) == {"unknown": 0.5, "other": 0.5}


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(11)
    rows = []
    for i in range(360):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        win = float(rng.random() < 1 / (1 + np.exp(-1.5 * x)))
        day = dt.date(2026, 4, 1) + dt.timedelta(days=i // 6)
        rows.append((i, day, f"T{i % 6}", f"T{(i + 1 + i // 6 % 5) % 6}", win,
                     int(4 + win + rng.randrange(3)), 4 if win else 9, x,
                     None if i % 5 == 0 else z, None))
    return spark.createDataFrame(
        rows, "game_pk long, game_date date, home_team string, away_team string, home_win double, "
              "home_score int, away_score int, x double, z double, empty double").withColumn(
        "league", F.lit("one")).cache()


def test_statistics_come_from_training_rows(spark, games):
    ens = models.input_stats(games, ["x", "z", "empty"])
    pdf = games.toPandas()
    assert ens.medians["z"] == pytest.approx(pdf["z"].median())
    assert ens.medians["empty"] == 0.0 and ens.scales["empty"] == 1.0
    assert ens.scales["x"] == pytest.approx(pdf["x"].std(ddof=0))


def test_logistic_solves_the_unit_penalty_problem(spark, games):
    """Gradient of mean loss plus (1/n) w vanishes at the fitted weights."""
    ens = models.fit(games, ["x", "z"], LINEAR)
    w, b = ens.models["logistic"].coefficients.toArray(), ens.models["logistic"].intercept
    pdf = games.toPandas()
    m = np.column_stack([(pdf[c].fillna(ens.medians[c]) - ens.means[c]) / ens.scales[c]
                         for c in ("x", "z")])
    err = 1 / (1 + np.exp(-(m @ w + b))) - pdf["home_win"].to_numpy()
    assert np.abs(m.T @ err + w).max() / len(pdf) < 1e-4
    assert abs(err.mean()) < 1e-4


def test_walk_forward_and_roster(spark, games):
    oof = models.walk_forward(games, ["x", "z"], QUICK, cadence=20).cache()
    sizes = {f["fold_idx"]: f["n_val"] for f in folds.fold_table(games, cadence=20).collect()}
    assert {r["fold_idx"]: r["count"] for r in oof.groupBy("fold_idx").count().collect()} == sizes
    p = oof.first()
    blend = sum(K.MEMBER_WEIGHTS[m] * p[f"p_{m}"] for m in K.MEMBER_WEIGHTS)
    assert p["home_win_prob_model"] == pytest.approx(blend)
    got = {r["name"]: r for r in models.roster(oof, ["boosted_a", "logistic"]).collect()}
    assert set(got) == set(K.MEMBER_WEIGHTS)
    assert got["logistic"]["weight"] == 0.3333 and got["boosted_b"]["weight"] == 0.0
    assert got["logistic"]["n_eval"] == sum(sizes.values()) and got["logistic"]["auc"] > 0.6


def test_small_folds_are_skipped_and_fallback_scores_newest(spark, games):
    assert models.walk_forward(games.limit(12), ["x"], LINEAR, cadence=1, min_val=50) is None
    ens, pooled, oof, roster = models.evaluate(games.where("game_pk < 30"), ["x"], LINEAR)
    assert oof.count() == 30 and pooled.first()["n"] == 30 and roster.count() == 3


def test_no_member_predicts_one_half(spark, games):
    ens = models.input_stats(games, ["x"])
    got = models.predict_games(ens, games).select("home_win_prob_model").distinct().collect()
    assert [r[0] for r in got] == [0.5]


def test_attributions_add_up_to_the_log_odds(spark, games):
    ens = models.fit(games, ["x", "z"], LINEAR)
    total = models.attributions(ens, games, "game_pk").groupBy("game_pk").agg(
        F.sum("attribution").alias("s"))
    p = models.member_probabilities(ens, games).select("game_pk", "p_logistic")
    b = ens.models["logistic"].intercept
    worst = total.join(p, "game_pk").select(F.max(F.abs(
        F.col("s") + b - F.ln(F.col("p_logistic") / (1 - F.col("p_logistic")))))).first()[0]
    assert worst < 1e-5
    assert models.attributions(ens, games, "game_pk", top=1).count() == 360


def test_other_heads(spark, games):
    g = games.withColumn("total_runs", F.col("home_score") + F.col("away_score"))
    _, errors = models.totals_head(g, g, ["x", "z"], QUICK)
    assert 0 < errors.first()["mae"] <= errors.first()["rmse"]
    out, scored = models.run_line_head(
        g, g, ["x", "z"], models.Settings(members=("boosted_a",), rounds=2, depth=2))
    assert scored.first()["n"] == 360
    assert out.where("_cover <> cast(home_score - away_score >= 2 as double)").count() == 0


def test_save_and_load(spark, games, tmp_path):
    ens = models.fit(games, ["x", "z"], QUICK)
    path = str(tmp_path / "m")
    assert models.load(path, spark) is None
    models.save(ens, {"auc": 0.6}, path, spark, "v9", dt.datetime(2026, 8, 22), "20260822")
    again = models.load(path, spark)
    assert again.metadata["version"] == "v9" and again.metadata["metrics"] == {"auc": 0.6}
    a = models.predict_games(ens, games).orderBy("game_pk").select("home_win_prob_model").collect()
    b = models.predict_games(again, games).orderBy("game_pk").select("home_win_prob_model").collect()
    assert a == b


def test_second_member_of_another_kind(spark, games, tmp_path):
    both = models.Settings(members=("boosted_a", "boosted_b"), rounds=3, depth=3, leaf_wise=True)
    ens = models.fit(games, ["x", "z", "empty"], both)
    assert len(ens.models["boosted_b"].trees) == 3
    out = models.member_probabilities(ens, games)
    assert out.where("abs(p_boosted_a - p_boosted_b) > 1e-4").count() > 100
    assert models.metrics.binary_metrics(out, p="p_boosted_b").first()["auc"] > 0.6
    models.save(ens, {}, str(tmp_path / "m"), spark, "v1", dt.datetime(2026, 8, 22), "20260822")
    again = models.load(str(tmp_path / "m"), spark)
    assert again.models["boosted_b"] == ens.models["boosted_b"]
    shares = models.attributions(ens, games, "game_pk", top=1, member="boosted_b")
    assert shares.count() == 360 and shares.where("feature = 'empty'").count() == 0


def test_retrain_cadence():
    now = dt.datetime(2026, 8, 22)
    assert models.should_retrain(None, now)
    assert models.should_retrain(now - dt.timedelta(days=7), now)
    assert not models.should_retrain(now - dt.timedelta(days=6), now)


# --- the daily run ----------------------------------------------------------------------------------

def test_daily_run(spark, games, tmp_path):
    ready = prepare_games(games).withColumnsRenamed({"x": "home_elo", "z": "woba_30g_home"})
    ready = ready.withColumn("woba_30g_away", F.col("home_elo") / 2)
    lines = ready.select("game_id", F.expr("start_time_utc - interval 2 hours")
                         .alias("line_posted_at"), F.lit(-120).alias("moneyline_home"),
                         F.lit(100).alias("moneyline_away"), F.lit(0.03).alias("juice"))
    out, now = str(tmp_path / "out"), dt.datetime(2026, 5, 30, 12)
    options = dict(lines=lines, settings=LINEAR, cadence=20,
                   features=["home_elo", "woba_30g_home", "woba_30g_away"])
    day = dt.date(2026, 5, 30)
    first = daily.run_daily(ready, day, out, now, **options)
    assert first["errors"] == [] and first["target_kind"] == "played"
    assert first["metrics"]["auc"] > 0.6
    slate = spark.read.option("header", True).csv(f"{out}/todays_games")
    assert slate.count() == 6 and {"edge_home", "model_pick", "run_date"} <= set(slate.columns)
    monitor = json.loads(spark.read.text(f"{out}/model_monitor").first()[0])
    assert len(monitor["feature_drift"]) == 3 and len(monitor["model_history"]) == 1

    schedule = spark.createDataFrame([("T0", "T1"), ("T2", "T3")],
                                     "home_team string, away_team string")
    later = dt.date(2026, 6, 2)
    second = daily.run_daily(ready, later, out, now + dt.timedelta(days=3), schedule=schedule,
                             last_trained=now, **options)
    assert second["errors"] == [] and second["target_kind"] == "upcoming"
    assert spark.read.parquet(f"{out}/model_history").count() == 1  # not retrained
    third = daily.run_daily(ready, later, out, now + dt.timedelta(days=3), last_trained=now,
                            **options)
    assert third["target_kind"] == "latest"
    failed = daily.run_daily(ready.limit(0), later, out, now, **options)
    assert failed["status"] == "error" and failed["errors"]


# --- work of the fits -------------------------------------------------------------------------------

def test_independent_fits_run_side_by_side_and_keep_their_order(spark):
    met = threading.Barrier(3, timeout=60)      # breaks if one waits for another to end

    def call(i):
        met.wait()
        return spark.range(i).count()

    assert models.side_by_side(spark, [lambda i=i: call(i) for i in (3, 1, 2)]) == [3, 1, 2]
    assert models.side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        models.side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_members_and_folds_are_fitted_side_by_side(spark, games, monkeypatch):
    members, together = threading.Barrier(3, timeout=60), threading.Barrier(2, timeout=60)
    fitted = models.fit

    class Waits:
        def __init__(self, algo):
            self.algo = algo

        def fit(self, data):
            members.wait()
            return self.algo.fit(data)

    boosted, linear = models._boosted, models.LogisticRegression
    monkeypatch.setattr(models, "_boosted", lambda *a: Waits(boosted(*a)))
    monkeypatch.setattr(models, "LogisticRegression", lambda **k: Waits(linear(**k)))
    assert list(models.fit(games, ["x", "z"], QUICK).models) == ["boosted_a", "boosted_b", "logistic"]

    monkeypatch.setattr(models, "LogisticRegression", linear)

    def fold(*args):
        together.wait()
        return fitted(*args)

    monkeypatch.setattr(models, "fit", fold)
    two = dict(cadence=20, max_folds=2)
    oof = models.walk_forward(games, ["x", "z"], LINEAR, **two)
    assert oof.count() == sum(f["n_val"] for f in folds.fold_table(games, **two).collect())


def test_fits_run_in_tasks_of_many_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(40)
    assert models.few_tasks(many, 100).rdd.getNumPartitions() == cores
    monkeypatch.setattr(models, "TASK_ROWS", 4)
    assert models.few_tasks(many, 100).rdd.getNumPartitions() == 25
    assert models.few_tasks(spark.range(0, 10, 1, 1), 10).rdd.getNumPartitions() == 1


def _rows_shuffled_for(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_attributions_shuffle_repeated_keys_only(spark, games):
    ens = models.fit(games, ["x", "z"], LINEAR)
    plain = models.attributions(ens, games, "game_pk")
    assert _rows_shuffled_for(plain) == 0
    twice = games.withColumn("game_pk", F.expr("case when game_pk < 3 then null when game_pk < 6 then 7 else game_pk end"))
    got = models.attributions(ens, twice, "game_pk")
    assert got.columns == plain.columns and got.schema["rank"].dataType == plain.schema["rank"].dataType
    size = collections.defaultdict(list)
    for r in got.collect():
        size[r["game_pk"]].append((r["rank"], -abs(r["attribution"]), r["feature"], r["signed_effect"], r["attribution"]))
    assert sum(map(len, size.values())) == 720 and len(size[None]) == 6 and len(size[7]) == 8
    for found in size.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1:3] for f in found] == sorted(f[1:3] for f in found)
        assert all(f[3] == ("positive" if f[4] > 0 else "negative") for f in found)
    assert models.attributions(ens, twice, "game_pk", top=1).count() == len(size)
