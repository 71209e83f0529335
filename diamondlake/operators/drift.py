"""Population stability and drift status for many features in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diamondlake.functions import scalars as S
from diamondlake.session import Stage

_COARSE = 64     # ranges between approximate quantiles
_FINE = 64       # equal parts of each of them


def long_form(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(kept columns, feature, value), observed values only."""
    return (df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(list(keep), list(features), "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def with_rank(values: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """(key, value, _n, _upto): distinct values with the number of values up to them.

    No task sees all values of a key. They are counted, cut into ranges (between approximate
    quantiles, each in equal parts) and ranked inside each range; the counts of lower ranges give
    the rank in the whole. The cuts only spread the work, ranks are exact. A key is a feature,
    that is a column of the source, so the per-key tables that are broadcast have at most one row
    per column and range.
    """
    counted = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    grid = [i / _COARSE for i in range(_COARSE + 1)]
    # both branches below read the cuts with the same columns, so they are taken once
    cuts = values.groupBy(key).agg(F.percentile_approx(value, grid, 2000).alias("_cuts"))
    v = F.col(value)
    at = F.greatest(F.lit(1), F.least(F.lit(_COARSE), F.size(F.filter("_cuts", lambda c: c < v))))
    ranged = (counted.join(F.broadcast(cuts), key).withColumn("_at", at)
              .withColumns({"_lo": F.get("_cuts", F.col("_at") - 1), "_hi": F.get("_cuts", "_at")})
              .withColumn("_part", F.greatest(F.lit(0), F.least(F.lit(_FINE - 1), F.floor(
                  F.coalesce(S.ratio((v.cast("double") - F.col("_lo")) * _FINE,
                                     F.col("_hi").cast("double") - F.col("_lo")),
                             F.lit(0.0))))))
              .select(key, value, "_c", (F.col("_at") * _FINE + F.col("_part"))
                      .cast("int").alias("_range")))
    lower = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(key, "_range").agg(F.sum("_c").alias("_rc"))
               .select(key, "_range",
                       F.coalesce(F.sum("_rc").over(lower), F.lit(0)).alias("_offset"),
                       F.sum("_rc").over(Window.partitionBy(key)).alias("_n")))
    within = Window.partitionBy(key, "_range").orderBy(value)
    return (ranged.withColumn("_local", F.sum("_c").over(within))
            .join(F.broadcast(offsets), [key, "_range"])
            .select(key, value, "_n", (F.col("_local") + F.col("_offset")).alias("_upto")))


def exact_quantiles(values: DataFrame, probs: Sequence[float], key: str = "feature",
                    value: str = "value") -> DataFrame:
    """(key, n, quantiles): exact quantiles with linear interpolation.

    The built-in exact percentile would keep every distinct value of a key in one buffer.
    """
    # the value at 0-based rank r is the smallest one with more than r values up to it
    position = [(F.col("_n") - 1) * F.lit(float(q)) for q in probs]
    picks = []
    for i, h in enumerate(position):
        picks.append(F.min(F.when(F.col("_upto") > F.floor(h), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(h), F.col(value))).alias(f"_hi{i}"))
    stats = with_rank(values, key, value).groupBy(key).agg(F.max("_n").alias("_n"), *picks)
    edges = []
    for i, h in enumerate(position):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        edges.append(lo + (hi - lo) * (h - F.floor(h)))
    return stats.select(key, F.col("_n").alias("n"), F.array(*edges).alias("quantiles"))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) per column; 0.0 where a column has no value at all."""
    found = exact_quantiles(long_form(df, columns), [0.5])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return (names.join(found, "feature", "left")
            .select("feature", F.coalesce(F.col("quantiles")[0], F.lit(0.0)).alias("median")))


def psi(values: DataFrame, bins: int = 10, key: str = "feature") -> DataFrame:
    """(feature, psi) from rows (feature, is_current, value).

    Bin edges are quantiles of both samples together, rounded to nine decimals and deduplicated;
    every bin gets half a count; 0 for constant or one-sided features.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(values, probs, key).select(key, F.array_distinct(
        F.transform("quantiles", lambda e: F.round(e, 9))).alias("_edges"))
    binned = (values.groupBy(key, "is_current", "value").agg(F.count(F.lit(1)).alias("_c"))
              .join(F.broadcast(edges), key)
              .withColumn("_k", F.size("_edges") - 1)
              .withColumn("_bin", F.greatest(F.lit(1), F.least(
                  F.col("_k"), F.size(F.filter("_edges", lambda e: e <= F.col("value")))))))
    counts = (binned.groupBy(key, "_k", "_bin")
              .agg(F.sum(F.when(F.col("is_current"), F.col("_c")).otherwise(0)).alias("_cur"),
                   F.sum(F.when(~F.col("is_current"), F.col("_c")).otherwise(0)).alias("_base")))
    # bins that neither sample reaches cannot occur between distinct quantiles of both samples,
    # except through rounding; they hold half a count on each side
    whole = Window.partitionBy(key)  # at most `bins` rows
    n_cur, n_base = F.sum("_cur").over(whole), F.sum("_base").over(whole)
    shares = counts.select(
        key, "_k", n_cur.alias("_nc"), n_base.alias("_nb"), F.count(F.lit(1)).over(whole).alias("_m"),
        ((F.col("_cur") + 0.5) / (n_cur + 0.5 * F.col("_k"))).alias("_pc"),
        ((F.col("_base") + 0.5) / (n_base + 0.5 * F.col("_k"))).alias("_pb"))
    empty_c = F.lit(0.5) / (F.col("_nc") + 0.5 * F.col("_k"))
    empty_b = F.lit(0.5) / (F.col("_nb") + 0.5 * F.col("_k"))
    total = (shares.where(F.col("_k") >= 1).groupBy(key, "_k", "_nc", "_nb", "_m")
             .agg(F.sum((F.col("_pc") - F.col("_pb")) * F.ln(F.col("_pc") / F.col("_pb")))
                   .alias("_s"))
             .withColumn("_s", F.col("_s") + (F.col("_k") - F.col("_m"))
                         * (empty_c - empty_b) * F.ln(empty_c / empty_b)))
    valid = (F.col("_nc") > 0) & (F.col("_nb") > 0)
    found = total.select(key, F.when(valid, F.col("_s")).otherwise(0.0).alias("_s"))
    return (edges.select(key).join(found, key, "left")
            .select(key, S.half_even(F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)), 6)
                    .alias("psi")))


def feature_drift(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drift row per feature observed in both windows.

    A status above OK needs both a noise-adjusted PSI beyond the threshold and a mean shift of
    more than two (clustering-inflated) standard errors; small windows are INSUFFICIENT. Each window is read
    once, into a table of its values; means, cuts, ranks and bins are taken from that table.
    """
    have = [f for f in features if f in baseline.columns and f in current.columns]
    values = (long_form(baseline.select(*have).withColumn("is_current", F.lit(False)), have,
                        "is_current")
              .unionByName(long_form(current.select(*have).withColumn("is_current", F.lit(True)),
                                     have, "is_current")))
    values = Stage(baseline.sparkSession).put("values", values)
    cur = F.col("is_current")

    def side(fn, cond):
        return fn(F.when(cond, F.col("value")))

    stats = values.groupBy("feature").agg(
        side(F.count, ~cur).alias("n_baseline"), side(F.count, cur).alias("n_current"),
        side(F.avg, ~cur).alias("_mb"), side(F.avg, cur).alias("_mc"),
        F.coalesce(side(F.var_samp, ~cur), F.lit(0.0)).alias("_vb"),
        F.coalesce(side(F.var_samp, cur), F.lit(0.0)).alias("_vc"),
    ).where((F.col("n_baseline") > 0) & (F.col("n_current") > 0))
    nb, nc = F.col("n_baseline"), F.col("n_current")
    pooled = F.when(nb + nc > 2, F.sqrt(
        S.ratio((nb - 1) * F.col("_vb") + (nc - 1) * F.col("_vc"), nb + nc - 2))).otherwise(0.0)
    out = stats.join(psi(values), "feature").withColumns({
        "_noise": S.psi_noise_floor("n_baseline", "n_current"),
        "_sd": pooled, "_shift": F.col("_mc") - F.col("_mb")})
    out = out.withColumn("_adj", F.greatest(F.col("psi") - F.col("_noise"), F.lit(0.0)))
    out = out.withColumn("_se", F.when(F.col("_sd") > 0, F.col("_sd") * F.sqrt(
        1.0 / nb + 1.0 / nc) * 1.5).otherwise(0.0))
    out = out.withColumn("location_shift", F.when(
        F.col("_sd") > 0, F.abs("_shift") > 2.0 * F.col("_se")).otherwise(F.col("_adj") > 0))
    status = (F.when((nb < 100) | (nc < 30), "INSUFFICIENT")
              .when(F.col("location_shift"), S.psi_status("_adj")).otherwise("OK"))
    return out.select(
        "feature", S.half_even("_mc", 4).alias("current_mean"),
        S.half_even("_mb", 4).alias("baseline_mean"), "psi",
        S.half_even("_adj", 6).alias("psi_adjusted"),
        S.half_even("_noise", 6).alias("noise_floor"),
        S.half_even("_shift", 6).alias("mean_shift"),
        S.half_even("_se", 6).alias("shift_se"), "location_shift", status.alias("status"),
        "n_baseline", "n_current")


def newest_rows(games: DataFrame, size: int, day: str = "game_date",
                tie: str = "game_pk") -> DataFrame:
    """The `size` newest rows by (day, tie), however large `size` is.

    Counts per date tell which dates are taken whole. In the date that is cut, ids are ranked in
    their own order: they are dealt by ranges and the counts of later ranges precede, so no task
    sorts the whole date. Numbers and strings are treated alike; of equal ids any stay.
    """
    counts = games.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n_day"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    budget = counts.select("_day", "_n_day", (
        F.lit(size) - F.coalesce(F.sum("_n_day").over(newer), F.lit(0))).alias("_room"))
    budget = budget.where(F.col("_room") > 0)  # one row per calendar date
    marked = games.join(F.broadcast(budget), F.col(day) == F.col("_day"))
    whole = marked.where(F.col("_n_day") <= F.col("_room"))
    partly = marked.where(F.col("_n_day") > F.col("_room"))
    dealt = Stage(games.sparkSession).put("cut_date", partly.repartitionByRange(
        F.col(tie).desc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select(
        "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))  # one row a range
    inside = Window.partitionBy("_part").orderBy(F.col(tie).desc_nulls_last())
    kept = (dealt.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(offsets), "_part")
            .where(F.col("_k") + F.col("_before") <= F.col("_room")))
    return whole.select(*games.columns).unionByName(kept.select(*games.columns))


def drift_windows(games: DataFrame, target_date, days: int = 7, ratio: int = 3,
                  at_least: int = 250) -> tuple[DataFrame, DataFrame]:
    """(baseline, current): decided games of the last days, and the newest rows before them.

    The baseline holds max(ratio * current, at_least) games; one count runs here.
    """
    decided = games.where(F.col("home_win").isNotNull())
    cutoff = F.date_sub(F.lit(target_date).cast("date"), days)
    current = decided.where(F.col("game_date") >= cutoff)
    size = max(ratio * current.count(), at_least)
    return newest_rows(decided.where(F.col("game_date") < cutoff), size), current


def drift_summary(drift: DataFrame) -> DataFrame:
    """Warning and alert counts with the flagged feature names (one entry per feature)."""
    flagged = F.col("status").isin("WARN", "ALERT")
    return drift.agg(F.count_if(F.col("status") == "WARN").alias("warnings"),
                     F.count_if(F.col("status") == "ALERT").alias("alerts"),
                     F.array_sort(F.collect_list(F.when(flagged, F.col("feature"))))
                      .alias("features"))


def feature_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null rows per column in percent, rounded to whole numbers."""
    have = [c for c in columns if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in have])
    return (wide.unpivot(["_n"], have, "feature", "seen")
            .select("feature", S.half_even(S.ratio(F.col("seen") * 100, "_n"), 0)
                    .alias("coverage_pct")))
