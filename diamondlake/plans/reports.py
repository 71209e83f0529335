"""Nested result records of a run."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import drift, metrics


def _nested(df: DataFrame, name: str) -> DataFrame:
    """All rows as one array; for tables bounded by features, members, buckets or dates."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))


def _beside(*one_row: DataFrame) -> DataFrame:
    """Put one-row frames side by side."""
    keyed = [f.withColumn("_one", F.lit(1)) for f in one_row]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def calibration_record(oof: DataFrame, run_date: str, target: DataFrame | None = None,
                       p: str = "home_win_prob_model", digits: int | None = 4) -> DataFrame:
    """One row: pooled metrics, reliability buckets and the per-day list.

    Out-of-fold rows are used unless the target day has more usable rows; rows count only where
    label and prediction are both known. The per-day list has one entry per calendar date.
    """
    usable = F.col("home_win").isNotNull() & F.col(p).isNotNull()
    rows = oof
    if target is not None and target.where(usable).count() > oof.where(usable).count():
        rows = target
    pooled = metrics.binary_metrics(oof, p=p, digits=digits).select(
        F.col("n").alias("n_games"), F.struct("auc", "brier", "logloss", "ece").alias("metrics"))
    return _beside(pooled, _nested(
        metrics.calibration_buckets(rows, p=p, digits=digits), "calibration_buckets"),
                   _nested(metrics.daily_calibration(oof, p=p, digits=digits), "daily")).select(
        F.lit(run_date).alias("date"), "n_games", "metrics", "calibration_buckets", "daily",
        F.col("n_games").alias("league_total"))


def monitor_record(pooled: DataFrame, drift_rows: DataFrame | None, brier: DataFrame | None,
                   run_date: str, version: str, last_retrained: str,
                   members: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row: metrics, drift summary and rows, rolling Brier, members, run history."""
    nxt = date.fromisoformat(last_retrained) + timedelta(days=K.RETRAIN_CADENCE)
    parts = [pooled.select(F.struct("auc", "brier", "logloss", "ece").alias("metrics"))]
    if drift_rows is not None:
        parts += [drift.drift_summary(drift_rows).select(
            F.struct("warnings", "alerts", "features").alias("drift_summary")),
            _nested(drift_rows, "feature_drift")]
    if brier is not None:
        parts.append(_nested(brier, "rolling_brier"))
    if members is not None:
        parts.append(_nested(members, "ensemble"))
    if history is not None:
        parts.append(_nested(history, "model_history"))
    return _beside(*parts).select(
        F.lit(run_date).alias("date"), F.lit(version).alias("version"),
        F.lit(last_retrained).alias("last_retrained"), F.lit(nxt.isoformat()).alias("next_retrain"),
        "*")


def retrain_countdown(monitor: DataFrame, day) -> DataFrame:
    """Days since the last and until the next retraining."""
    d = F.lit(day).cast("date")
    return monitor.select(
        F.coalesce(F.datediff(d, F.to_date("last_retrained")), F.lit(0)).alias("days_since"),
        F.coalesce(F.datediff(F.to_date("next_retrain"), d), F.lit(0)).alias("days_until"))


def accuracy(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("n_games"),
                       S.half_even(F.avg("correct") * 100, 1).alias("accuracy_pct"))
