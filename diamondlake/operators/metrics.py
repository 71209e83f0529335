"""Probability metrics and calibration, overall or per group, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S

EPS = 1e-7
ECE_EDGES = [i * 0.1 for i in range(10)] + [1.0]
BUCKET_EDGES = [0.5 + i * 0.1 for i in range(5)] + [1.0]
_AUC_BINS = 4096


def bin_by_edges(x, edges: Sequence[float], closed_top: bool = False) -> Column:
    """Index of the half-open bin [edge, next edge); NULL outside.

    The edges are compared as written, since computing a bin by division puts values that lie on
    an edge on the wrong side.
    """
    c = F.col(x) if isinstance(x, str) else x
    out = None
    for i in range(len(edges) - 1):
        top = (c <= edges[i + 1]) if closed_top and i == len(edges) - 2 else (c < edges[i + 1])
        cond = (c >= edges[i]) & top
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def _even(c, digits: int | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if digits is None else S.half_even(c, digits)


def _scored(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    return (df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
            .select(*by, F.col(y).cast("double").alias("_y"),
                    F.col(p).cast("double").alias("_raw"))
            .withColumn("_p", S.clip("_raw", EPS, 1 - EPS)))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with ties counted half; 0.5 when only one class occurs.

    Equal scores are merged first. Score bins then take the place of one global sort: negatives in
    lower bins come from a table with one row per bin, those within the bin from a window over it.
    """
    by = list(by)
    s = _scored(df, y, p, by)
    per_score = (s.groupBy(*by, "_p")
                 .agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
                 .withColumn("_bin", F.floor(F.col("_p") * _AUC_BINS)))
    bins = per_score.groupBy(*by, "_bin").agg(F.sum("_neg").alias("_bin_neg"))
    lower = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col("_bin").alias("_k_bin"),
        F.coalesce(F.sum("_bin_neg").over(lower), F.lit(0.0)).alias("_offset"))
    same = F.col("_bin") == F.col("_k_bin")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    within = (Window.partitionBy(*by, "_bin").orderBy("_p")
              .rowsBetween(Window.unboundedPreceding, -1))
    u = (per_score.withColumn("_below", F.coalesce(F.sum("_neg").over(within), F.lit(0.0)))
         .join(offsets, same)
         .groupBy(*by).agg(
             F.sum(F.col("_pos") * (F.col("_offset") + F.col("_below") + F.col("_neg") / 2))
              .alias("_u"),
             F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn")))
    return u.select(*by, F.coalesce(S.ratio("_u", F.col("_np") * F.col("_nn")), F.lit(0.5))
                    .alias("auc"))


def binary_metrics(df: DataFrame, y: str = "home_win", p: str = "home_win_prob_model",
                   by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """n, AUC, Brier, log-loss and expected calibration error per group."""
    by = list(by)
    s = _scored(df, y, p, by)
    p_, y_ = F.col("_p"), F.col("_y")
    per_bin = (s.withColumn("_b", bin_by_edges("_p", ECE_EDGES)).groupBy(*by, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy"), F.sum("_p").alias("_sp"),
        F.sum((p_ - y_) * (p_ - y_)).alias("_sq"),
        F.sum(-(y_ * F.ln(p_) + (1 - y_) * F.ln(1 - p_))).alias("_ll")))
    flat = per_bin.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (F.sum("_sq") / F.sum("_n")).alias("brier"),
        (F.sum("_ll") / F.sum("_n")).alias("logloss"),
        (F.sum(F.abs(F.col("_sy") - F.col("_sp"))) / F.sum("_n")).alias("ece"))
    ranked = auc(df, y, p, by).withColumnsRenamed({b: f"_k_{b}" for b in by})
    flat, ranked = flat.withColumn("_one", F.lit(1)), ranked.withColumn("_k_one", F.lit(1))
    same = F.col("_one") == F.col("_k_one")  # without groups both sides have one row
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    out = flat.join(ranked, same)
    cols = ["auc", "brier", "logloss", "ece"]
    return out.select(*by, "n", *[_even(c, digits).alias(c) for c in cols])


def calibration_buckets(df: DataFrame, y: str = "home_win", p: str = "home_win_prob_model",
                        by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """Reliability table of the favoured side: each game once, at max(p, 1-p) in [0.5, 1]."""
    by = list(by)
    s = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        *by, F.greatest(F.col(p), 1 - F.col(p)).alias("_f"),
        F.when(F.col(p) >= 0.5, F.col(y)).otherwise(1 - F.col(y)).cast("double").alias("_won"))
    b = s.withColumn("_b", bin_by_edges("_f", BUCKET_EDGES, closed_top=True))
    low = (F.col("_b") * 10 + 50).cast("int")
    g = b.groupBy(*by, "_b").agg(
        _even(F.avg("_f"), digits).alias("mean_predicted"),
        _even(F.avg("_won"), digits).alias("mean_actual"),
        F.count(F.lit(1)).alias("count"))
    return g.select(*by, F.format_string("%d–%d%%", low, low + 10).alias("bucket"),
                    "mean_predicted", "mean_actual", "count",
                    _even(F.col("mean_predicted") - F.col("mean_actual"), digits).alias("gap"))


def reliability_with_total(buckets: DataFrame) -> DataFrame:
    """The bucket rows plus a count-weighted TOTAL row."""
    n = F.col("count")
    return (buckets.rollup("bucket").agg(
        (F.sum(F.col("mean_predicted") * n) / F.sum(n)).alias("mean_predicted"),
        (F.sum(F.col("mean_actual") * n) / F.sum(n)).alias("mean_actual"),
        F.sum(n).alias("count"))
        .withColumn("bucket", F.coalesce("bucket", F.lit("TOTAL")))
        .withColumn("gap", F.col("mean_predicted") - F.col("mean_actual")))


def daily_calibration(oof: DataFrame, y: str = "home_win", p: str = "home_win_prob_model",
                      day: str = "game_date", digits: int | None = 4) -> DataFrame:
    """One row per date with decided, scored games: counts, metrics, nested bucket list.

    `home_wins` counts home wins and `picks_correct` correct picks.
    """
    ok = (oof.where(F.col(y).isNotNull() & F.col(p).isNotNull())
          .withColumn("date", F.date_format(day, "yyyyMMdd")))
    counts = ok.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_games"),
        F.sum(S.flag(F.col(y) == 1)).alias("home_wins"),
        F.sum(S.flag(F.col(y) == 0)).alias("home_losses"),
        F.sum(S.flag((F.col(p) >= 0.5) == (F.col(y) == 1))).alias("picks_correct"))
    m = binary_metrics(ok, y, p, ["date"], digits).drop("n")
    # at most five buckets per date
    nested = (calibration_buckets(ok, y, p, ["date"], digits).groupBy("date").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "mean_predicted", "mean_actual", "count",
                                             "gap"))).alias("buckets")))
    return (counts.join(m, "date").join(nested, "date")
            .select("date", "n_games", "home_wins", "home_losses", "picks_correct",
                    F.struct("auc", "brier", "logloss", "ece").alias("metrics"), "buckets"))


def rolling_brier(oof: DataFrame, y: str = "home_win", p: str = "home_win_prob_model",
                  day: str = "game_date", days: int = 30, baseline: float = 0.23) -> DataFrame:
    """Brier score over the trailing days, from one row of sums per date."""
    d = F.col(p) - F.col(y)
    daily = (oof.where(F.col(y).isNotNull() & F.col(p).isNotNull())
             .groupBy(F.col(day).alias("date"))
             .agg(F.sum(d * d).alias("_s"), F.count(F.lit(1)).alias("_n")))
    w = Window.orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return daily.select("date", F.sum("_n").over(w).alias("n"),
                        (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("brier"),
                        F.lit(baseline).alias("baseline"))


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.agg(S.half_even(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
                  S.half_even(F.avg(F.abs(e)), 4).alias("mae"))


def edges_against_market(df: DataFrame, prob: str = "home_win_prob_model") -> DataFrame:
    """Model probability minus the vig-free market one; 0.0 when no row has a line."""
    fair_home, fair_away = S.fair_pair("moneyline_home", "moneyline_away")
    any_line = df.agg(F.coalesce(F.max(F.col("moneyline_home").isNotNull()), F.lit(False))
                      .alias("_any_line"))  # one row
    any_line = any_line.withColumn("_k_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(
        F.broadcast(any_line), F.col("_one") == F.col("_k_one"))
    return (joined.withColumns({
        "edge_home": F.when(F.col("_any_line"), S.half_even(F.col(prob) - fair_home, 4))
        .otherwise(0.0),
        "edge_away": F.when(F.col("_any_line"), S.half_even(1 - F.col(prob) - fair_away, 4))
        .otherwise(0.0)}).drop("_any_line", "_one", "_k_one"))


# --- prediction rows -------------------------------------------------------------------------------

def prediction_history(oof: DataFrame, p: str = "home_win_prob_model") -> DataFrame:
    """Decided, scored games: pick, winner, correctness and the picked side's probability."""
    df = oof.where(F.col("home_win").isNotNull() & F.col(p).isNotNull())
    keep = [c for c in ("game_id", "game_pk", "game_date", "home_team", "away_team",
                        "home_score", "away_score", "home_win", p) if c in df.columns]
    return df.select(*keep).withColumns({
        "model_pick": S.pick(p), "actual_winner": S.winner(),
        "correct": S.flag((F.col(p) >= 0.5) == (F.col("home_win") == 1)),
        "pick_prob": F.greatest(F.col(p), 1 - F.col(p))})


def newest_first(df: DataFrame, day: str = "game_date", then: str = "game_id") -> DataFrame:
    return df.orderBy(F.desc(day), F.asc(then))


def display_columns(df: DataFrame, now, p: str = "home_win_prob_model") -> DataFrame:
    """Status, day part, team names, correctness, upset and coin-flip flags of a game list."""
    if "model_pick" not in df.columns:
        df = df.withColumn("model_pick", F.coalesce(S.pick(p), F.lit("")))
    won = S.winner()
    prob = F.col(p)
    winner_prob = F.when(F.col("home_win") == 1, prob).otherwise(1 - prob)
    decided = F.col("home_win").isNotNull()
    evening = S.is_evening("start_time_utc")
    return df.withColumns({
        "game_status": S.game_status("home_win", "start_time_utc", now),
        "evening_game": evening, "day_game": ~evening,
        "home_team_name": F.coalesce(S.lookup("home_team", K.TEAM_NAMES), F.lit("")),
        "away_team_name": F.coalesce(S.lookup("away_team", K.TEAM_NAMES), F.lit("")),
        "final_inning": F.lit(""),
        "model_correct": F.coalesce(decided & (F.col("model_pick") == won), F.lit(False)),
        "is_upset": F.coalesce(decided & (winner_prob <= K.UPSET_PROBABILITY), F.lit(False)),
        "is_coin_flip": F.coalesce((F.coalesce("model_pick", F.lit("")) == "")
                                   | (F.abs(prob - 0.5) < K.COIN_FLIP_BAND), F.lit(False)),
    })


def fill_scores(df: DataFrame, scores: DataFrame, key: str = "game_id") -> DataFrame:
    """Fill missing scores from another frame with one row per key; present values win."""
    cols = ("home_score", "away_score")
    other = scores.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    joined = df.join(other, key, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in df.columns else F.col(f"_{c}")
        for c in cols}).drop(*[f"_{c}" for c in cols])


def status_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("all_games"),
                  F.count_if(F.col("game_status") == "Final").alias("final"),
                  F.count_if(F.col("game_status") == "Live").alias("live"))


def day_record(df: DataFrame) -> DataFrame:
    """Picks right and wrong over decided games, and how many were upsets."""
    decided = F.col("home_win").isNotNull()
    right = F.count_if(decided & F.col("model_correct"))
    done = F.count_if(decided)
    return df.agg(right.alias("wins"), (done - right).alias("losses"), done.alias("completed"),
                  F.count_if(F.col("is_upset")).alias("upsets"))


def upsets(df: DataFrame, p: str = "home_win_prob_model") -> DataFrame:
    prob = F.when(F.col("home_win") == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.where("is_upset").select("game_pk", S.winner().alias("team"), prob.alias("prob"))
