"""One daily run: evaluate, refit, predict the day's games, write every result table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import drift, metrics, models, prior, ratings
from diamondlake.plans import reports, slate
from diamondlake.session import Stage
from diamondlake.sources import artifacts

LINE_COLUMNS = ["moneyline_home", "moneyline_away", "total_line", "run_line_home",
                "run_line_away", "juice"]


def attach_lines(games: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Latest line before the start of each game; without lines the games stay as they are."""
    if lines is None:
        return games
    have = [c for c in LINE_COLUMNS if c in lines.columns]
    kept = games.drop(*have)
    lines = lines.withColumn("_tie", F.xxhash64(*have))     # of one instant always the same line
    return prior.asof_attach(kept, lines, "game_id", "start_time_utc", "line_posted_at", have,
                             {"juice": K.DEFAULT_JUICE} if "juice" in have else None, "_tie")


def target_games(games: DataFrame, day: date, schedule: DataFrame | None,
                 pitches: DataFrame | None) -> tuple[DataFrame, str]:
    """Rows of the day; else its upcoming slate; else the latest fifteen games."""
    today = games.where(F.col("game_date") == F.lit(day).cast("date"))
    if today.limit(1).count():
        return today, "played"
    if schedule is not None and schedule.limit(1).count():
        names = slate.name_crosswalk(pitches) if pitches is not None else None
        return slate.build_upcoming_slate(games, day, schedule, names), "upcoming"
    return artifacts.latest_rows(games, ["game_date", "game_pk"], 15), "latest"


def run_daily(games: DataFrame, day: date, out: str, now: datetime,
              lines: DataFrame | None = None, schedule: DataFrame | None = None,
              pitches: DataFrame | None = None, features: Sequence[str] | None = None,
              settings: models.Settings | None = None, version: str = "v1",
              last_trained: datetime | None = None, force_retrain: bool = False,
              min_train_days: int = 0, max_folds: int = 0,
              cadence: int = K.RETRAIN_CADENCE) -> dict:
    """Run the day and return its status, written paths and pooled metrics.

    `games` are prepared and enriched game rows. A failure is reported in the result, not raised.
    """
    spark = games.sparkSession
    run = day.strftime("%Y%m%d")
    result = {"status": "ok", "target_date": run, "artifacts": [], "metrics": {}, "errors": []}

    def wrote(name: str) -> str:
        result["artifacts"].append(f"{out}/{name}")
        return f"{out}/{name}"

    try:
        stage = Stage(spark)
        games = stage.put("games", attach_lines(games, lines))
        if games.limit(1).count() == 0:
            raise ValueError("no games given")
        inputs = list(features or [c for c in K.FEATURES if c in games.columns])

        # --- models
        ens = models.load(f"{out}/model", spark)
        oof = members = None
        if ens is None or force_retrain or models.should_retrain(last_trained, now, cadence):
            ens, pooled, oof, members = models.evaluate(
                games, inputs, settings, cadence=cadence, min_train_days=min_train_days,
                max_folds=max_folds)
            oof = stage.put("oof", oof)
            pooled = metrics.binary_metrics(oof).first().asDict()
            members = models.roster(oof, list(ens.models))
            models.save(ens, pooled, f"{out}/model", spark, version, now, run)
            last_trained = now
            artifacts.append_history(spark.createDataFrame(
                [(version, day.isoformat(), pooled["auc"], pooled["brier"], pooled["logloss"],
                  pooled["ece"], "")],
                "version string, date string, auc double, brier double, logloss double, "
                "ece double, notes string"), wrote("model_history"))
        else:
            pooled = ens.metadata["metrics"]
        result["metrics"] = pooled

        # --- predictions of the day
        today, kind = target_games(games, day, schedule, pitches)
        result["target_kind"] = kind
        missing = [c for c in ens.features if c not in today.columns]
        today = today.withColumns({c: F.lit(None).cast("double") for c in missing})
        today = stage.put("today", models.predict_games(ens, today))
        artifacts.write_slate(today, wrote("todays_games"), run)
        every = games
        if kind == "upcoming":
            every = games.unionByName(today.select(*[c for c in today.columns
                                                     if c in games.columns]),
                                      allowMissingColumns=True)
        artifacts.write_csv(ratings.power_rankings(every), wrote("power_rankings"), run)
        if oof is not None:
            artifacts.write_json(reports.calibration_record(oof, run, today),
                                 wrote("calibration"), run)
            artifacts.write_csv(metrics.prediction_history(oof), wrote("predictions_history"), run)
        if "logistic" in ens.models:
            artifacts.write_csv(models.attributions(ens, today), wrote("attributions"), run, ["game_id"])

        # --- drift and monitor
        base, cur = drift.drift_windows(games, day)
        drift_rows = stage.put("drift", drift.feature_drift(base, cur, inputs))
        artifacts.write_csv(drift_rows, wrote("feature_drift"), run)
        pooled_row = spark.createDataFrame(
            [tuple(float(pooled[c]) for c in ("auc", "brier", "logloss", "ece"))],
            "auc double, brier double, logloss double, ece double")
        artifacts.write_json(reports.monitor_record(
            pooled_row, drift_rows, metrics.rolling_brier(oof) if oof is not None else None, run,
            version, (last_trained or now).date().isoformat(), members,
            spark.read.parquet(f"{out}/model_history")), wrote("model_monitor"), run)
    except Exception as failure:  # the caller decides what a failed day means
        result["status"] = "error"
        result["errors"].append(f"{type(failure).__name__}: {failure}")
    return result


def with_scores(games: DataFrame) -> DataFrame:
    """Label and total from the scores of decided games."""
    return games.withColumns({"home_win": S.winner_label(),
                              "total_runs": F.col("home_score") + F.col("away_score")})
