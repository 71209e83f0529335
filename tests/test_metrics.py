import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from diamondlake.operators import metrics


def scored(spark, pairs):
    return spark.createDataFrame([(float(y), float(p)) for y, p in pairs],
                                 "home_win double, home_win_prob_model double")


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    return [(int(rng.random() < 0.55), round(rng.random(), 2)) for _ in range(500)]


def test_metrics_against_plain_python(spark, sample):
    got = metrics.binary_metrics(scored(spark, sample), digits=None).first()
    pos = [p for y, p in sample if y]
    neg = [p for y, p in sample if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert got["n"] == 500
    assert got["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    clipped = [(y, min(max(p, 1e-7), 1 - 1e-7)) for y, p in sample]
    assert got["brier"] == pytest.approx(sum((y - p) ** 2 for y, p in clipped) / 500)
    ll = -sum(y * math.log(p) + (1 - y) * math.log(1 - p) for y, p in clipped) / 500
    assert got["logloss"] == pytest.approx(ll)
    ece = 0.0
    for i in range(10):
        lo, hi = metrics.ECE_EDGES[i], metrics.ECE_EDGES[i + 1]
        b = [(y, p) for y, p in clipped if lo <= p < hi]
        ece += abs(sum(y for y, _ in b) - sum(p for _, p in b)) / 500
    assert got["ece"] == pytest.approx(ece)


def test_single_class_auc_is_one_half(spark):
    got = metrics.binary_metrics(scored(spark, [(1, 0.2), (1, 0.9)])).first()
    assert got["auc"] == 0.5


def test_groups_match_separate_runs(spark, sample):
    df = scored(spark, sample).withColumn("g", F.when(F.col("home_win_prob_model") < 0.4, "low"))
    both = {r["g"]: r for r in metrics.binary_metrics(df, by=["g"]).collect()}
    low = metrics.binary_metrics(df.where("g = 'low'")).first()
    assert (both["low"]["auc"], both["low"]["ece"]) == (low["auc"], low["ece"])
    assert both[None]["n"] + both["low"]["n"] == 500


def buckets(spark, pairs):
    return {r["bucket"]: r for r in metrics.calibration_buckets(scored(spark, pairs)).collect()}


def test_buckets_take_the_favoured_side(spark):
    got = buckets(spark, [(1, 0.60), (0, 0.40)])
    assert set(got) == {"60–70%"}
    assert got["60–70%"]["mean_actual"] == 1.0 and got["60–70%"]["count"] == 2
    assert buckets(spark, [(1, 0.40)])["60–70%"]["gap"] == pytest.approx(0.6)


def test_top_bucket_is_closed(spark):
    assert set(buckets(spark, [(1, 1.0), (0, 0.0)])) == {"90–100%"}


def test_every_game_is_counted_once(spark, sample):
    assert sum(b["count"] for b in buckets(spark, sample).values()) == 500


def test_edges_sit_in_the_upper_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.6, 0.7, 0.8, 0.9)], "x double")
    got = [r["b"] for r in df.select(
        metrics.bin_by_edges("x", metrics.BUCKET_EDGES, True).alias("b")).collect()]
    assert got == [0, 1, 2, 3, 4]


def test_total_row_is_count_weighted(spark, sample):
    b = metrics.calibration_buckets(scored(spark, sample))
    total = metrics.reliability_with_total(b).where("bucket = 'TOTAL'").first()
    rows = b.collect()
    assert total["count"] == 500
    assert total["mean_predicted"] == pytest.approx(
        sum(r["mean_predicted"] * r["count"] for r in rows) / 500)


def test_daily_rows_skip_days_without_usable_games(spark):
    df = spark.createDataFrame(
        [(dt.date(2026, 1, 1), 1.0, 0.7), (dt.date(2026, 1, 1), 0.0, 0.2),
         (dt.date(2026, 1, 2), None, 0.7), (dt.date(2026, 1, 3), 1.0, 0.4)],
        "game_date date, home_win double, home_win_prob_model double")
    got = {r["date"]: r for r in metrics.daily_calibration(df).collect()}
    assert set(got) == {"20260101", "20260103"}
    first = got["20260101"]
    assert (first["n_games"], first["home_wins"], first["picks_correct"]) == (2, 1, 2)
    assert got["20260103"]["metrics"]["auc"] == 0.5
    assert sum(b["count"] for b in first["buckets"]) == 2


def history(spark):
    rows = [("g1", dt.date(2026, 8, 1), "BOS", "PHI", 3, 4, 0.0, 0.62),
            ("g2", dt.date(2026, 8, 2), "BOS", "NYY", 5, 1, 1.0, 0.58),
            ("g3", dt.date(2026, 8, 3), "SEA", "LAD", None, None, None, 0.51)]
    return spark.createDataFrame(rows, "game_id string, game_date date, home_team string, "
                                       "away_team string, home_score int, away_score int, "
                                       "home_win double, home_win_prob_model double")


def test_history_has_decided_games_newest_first(spark):
    got = metrics.newest_first(metrics.prediction_history(history(spark))).collect()
    assert [r["game_id"] for r in got] == ["g2", "g1"]
    assert [r["correct"] for r in got] == [1, 0]
    assert got[1]["actual_winner"] == "PHI" and got[1]["model_pick"] == "BOS"
    assert metrics.prediction_history(history(spark).where("home_win is null")).count() == 0


def test_display_flags(spark):
    df = history(spark).withColumn("start_time_utc", F.expr(
        "cast(game_date as timestamp_ntz) + interval 23 hours"))
    now = F.lit(dt.datetime(2026, 8, 3)).cast("timestamp_ntz")
    got = {r["game_id"]: r for r in metrics.display_columns(df, now).collect()}
    assert got["g1"]["game_status"] == "Final" and got["g3"]["game_status"] == "Scheduled"
    assert got["g1"]["evening_game"] and not got["g1"]["day_game"]  # 19:00 New York
    assert not got["g1"]["model_correct"] and got["g2"]["model_correct"]
    assert not got["g1"]["is_upset"] and got["g3"]["is_coin_flip"]
    assert got["g1"]["home_team_name"] == "Boston Red Sox"


def test_edges_are_zero_without_any_line(spark):
    df = history(spark).withColumns({"moneyline_home": F.lit(None).cast("int"),
                                     "moneyline_away": F.lit(None).cast("int")})
    assert {r["edge_home"] for r in metrics.edges_against_market(df).collect()} == {0.0}


def test_missing_line_counts_as_default(spark):
    df = history(spark).withColumns({
        "moneyline_home": F.when(F.col("game_id") == "g1", -150),
        "moneyline_away": F.when(F.col("game_id") == "g1", 130)})
    got = {r["game_id"]: r["edge_home"] for r in metrics.edges_against_market(df).collect()}
    h, a = 150 / 250, 100 / 230
    assert got["g1"] == round(0.62 - h / (h + a), 4)
    assert got["g2"] == pytest.approx(0.08)


def test_rolling_brier_window(spark):
    df = spark.createDataFrame(
        [(dt.date(2026, 1, 1), 1.0, 0.0), (dt.date(2026, 1, 30), 1.0, 1.0),
         (dt.date(2026, 1, 31), 1.0, 0.5)],
        "game_date date, home_win double, home_win_prob_model double")
    got = [r["brier"] for r in metrics.rolling_brier(df).orderBy("date").collect()]
    assert got == [1.0, 0.5, 0.125]


def test_fill_scores_prefers_present_values(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", None, None)],
                              "game_id string, home_score int, away_score int")
    b = spark.createDataFrame([("x", 9, 8)], a.schema)
    got = {r["game_id"]: (r["home_score"], r["away_score"])
           for r in metrics.fill_scores(a, b).collect()}
    assert got == {"x": (1, 8), "y": (None, None)}
