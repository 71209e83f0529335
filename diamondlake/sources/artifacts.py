"""Write and find result files, and read nested result documents back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.sources.landing import existing


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Globally ordered files: range partitions, each sorted, without a single-task sort."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, run_date: str, by: Sequence[str] = ()) -> None:
    """CSV with header under run_date=…; other runs stay."""
    (df.withColumn("run_date", F.lit(run_date))
     .write.mode("overwrite").option("header", True)
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", *by).csv(path))


def write_slate(df: DataFrame, path: str, run_date: str) -> None:
    """The games of a day, a few rows, in one file ordered by start time."""
    order = [c for c in ("start_time_utc", "game_id") if c in df.columns]
    write_csv(existing(df.coalesce(1).sortWithinPartitions(*order), K.SLATE_COLUMNS), path, run_date)


def write_json(df: DataFrame, path: str, run_date: str) -> None:
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path))


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# --- finding runs ----------------------------------------------------------------------------------

def run_dates(runs: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Distinct run dates, newest first, together with calibrated days in yyyyMMdd form."""
    dates = runs.select(F.col("run_date").cast("string").alias("run_date"))
    if daily is not None:
        days = daily.select(F.col("date").cast("string").alias("run_date"))
        dates = dates.unionByName(days.where(F.col("run_date").rlike("^[0-9]{8}$")))
    return dates.distinct().orderBy(F.desc("run_date"))


def pick_run(dates: DataFrame, wanted: str | None) -> DataFrame:
    """The wanted date if present, else the newest (one row)."""
    return dates.agg(F.coalesce(
        F.max(F.when(F.col("run_date") == F.lit(wanted), F.col("run_date"))),
        F.max("run_date")).alias("run_date"))


def read_run(spark: SparkSession, path: str, run_date: str | date, schema: str) -> DataFrame:
    """Rows of one run; the date is a partition filter. Headers must name the schema's columns."""
    return (spark.read.option("header", True).option("enforceSchema", False).schema(schema + ", run_date string").csv(path)
            .where(F.col("run_date") == str(run_date)))


# --- reading documents back ------------------------------------------------------------------------

_METRICS = "struct<auc:double,brier:double,logloss:double,ece:double>"
_BUCKETS = ("array<struct<bucket:string,mean_predicted:double,mean_actual:double,count:bigint,"
            "gap:double>>")
CALIBRATION = (f"date string, n_games bigint, metrics {_METRICS}, "
               f"calibration_buckets {_BUCKETS}, calibration_curve {_BUCKETS}, "
               f"daily array<struct<date:string,n_games:bigint,wins:bigint,losses:bigint,"
               f"home_wins:bigint,home_losses:bigint,"
               f"metrics:{_METRICS},buckets:{_BUCKETS}>>")


def calibration_view(documents: DataFrame, day: str) -> DataFrame:
    """Document rows as the report reads them: the day's own entry where there is one.

    `wins`/`losses` of a daily entry fall back to `home_wins`/`home_losses`.
    """
    entry = F.try_element_at(F.filter("daily", lambda d: d["date"] == day), F.lit(1))
    one = documents.withColumn("_day", entry)
    day_buckets = F.when(F.size("_day.buckets") > 0, F.col("_day.buckets"))
    one = one.withColumns({
        "_m": F.when(F.col("_day").isNotNull(), F.col("_day.metrics"))
        .otherwise(F.col("metrics")),
        "calibration_curve": F.coalesce(day_buckets, F.when(
            F.size("calibration_curve") > 0, F.col("calibration_curve")),
            F.col("calibration_buckets"))})
    return one.select(
        "date", F.struct(F.col("_m.auc").alias("auc_roc"), F.col("_m.brier").alias("brier_score"),
                         F.col("_m.logloss").alias("log_loss"),
                         F.col("_m.ece").alias("cal_error")).alias("kpis"),
        "calibration_curve",
        F.transform("calibration_curve", lambda b: F.struct(
            b["bucket"].alias("bucket"), F.coalesce(b["count"], F.lit(0)).alias("count"),
            F.bround(F.coalesce(b["mean_actual"], F.lit(0.0)) * 100, 1).alias("accuracy_pct")))
        .alias("confidence"),
        F.when(F.col("_day").isNotNull(), F.struct(
            F.coalesce("_day.wins", "_day.home_wins", F.lit(0)).alias("wins"),
            F.coalesce("_day.losses", "_day.home_losses", F.lit(0)).alias("losses"),
            F.coalesce("_day.n_games", F.lit(0)).alias("completed"))).alias("day_record"))


def ranking_view(rankings: DataFrame) -> DataFrame:
    """Both spellings of the win and loss columns."""
    return rankings.withColumns({new: F.col(old) for old, new in (("wins", "w"), ("losses", "l"))
                                 if old in rankings.columns and new not in rankings.columns})


def top_by(df: DataFrame, column: str, k: int, absolute: bool = False,
           tie_break: str | None = None) -> DataFrame:
    """The k rows with the largest (absolute) value."""
    key = F.abs(column) if absolute else F.col(column)
    return df.orderBy(key.desc(), *([F.col(tie_break)] if tie_break else [])).limit(k)


def latest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows in order (a top-n, not a full sort)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
