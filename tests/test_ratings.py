import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from diamondlake.operators import ratings
from diamondlake.operators.prior import day_of, hot_split
from diamondlake.session import Stage

SCHEMA = ("game_pk long, game_date date, home_team string, away_team string, home_win double, "
          "home_score int, away_score int")


def games(spark, rows):
    return spark.createDataFrame(
        [(i, dt.date.fromisoformat(d), h, a, None if w is None else float(w), hs, as_)
         for i, (d, h, a, w, hs, as_) in enumerate(rows)], SCHEMA).withColumn("league", F.lit("one"))


SEASONS = [("2025-04-01", "BOS", "SEA", 1, 5, 3), ("2025-04-02", "BOS", "NYY", 1, 8, 2),
           ("2025-04-03", "SEA", "NYY", 0, 0, 1), ("2025-04-04", "NYY", "BOS", None, None, None),
           ("2026-03-17", "BOS", "SEA", 1, 2, 1)]


def test_first_rating_is_the_start_value(spark):
    got = ratings.elo_entering(games(spark, SEASONS)).orderBy("game_pk").collect()
    assert got[0]["home_elo"] == 1500.0 and got[0]["away_elo"] == 1500.0


def test_elo_values_update_and_season_revert(spark):
    got = [r["home_elo"] for r in ratings.elo_entering(games(spark, [
        ("2025-04-01", "A", "B", 1, 1, 0), ("2025-04-02", "A", "C", None, None, None),
        ("2025-04-03", "A", "C", 1, 1, 0), ("2026-04-01", "A", "B", 1, 1, 0)]))
        .orderBy("game_pk").collect()]
    assert got[0] == 1500.0
    assert got[1] == got[2] == pytest.approx(1508.1506753883134, abs=1e-9)
    e = got[2] + 20 * (1 - 1 / (1 + 10 ** ((1500 - got[2] - 65) / 400)))
    assert got[3] == pytest.approx(e + (1500 - e) / 3, abs=1e-9)


def test_elo_as_of_uses_only_earlier_games(spark):
    df = games(spark, SEASONS).selectExpr("*", "cast(game_date as timestamp_ntz) start_time_utc")
    early = {r["team"]: r["elo"] for r in ratings.elo_as_of(
        df, dt.datetime(2025, 4, 2)).collect()}
    assert set(early) == {"BOS", "SEA"}
    assert early["BOS"] > 1500 > early["SEA"]
    assert early["BOS"] + early["SEA"] == pytest.approx(3000)


def test_future_game_leaves_earlier_ratings_alone(spark):
    more = SEASONS + [("2027-01-01", "SEA", "BOS", 1, 99, 0)]
    a = ratings.elo_entering(games(spark, SEASONS)).orderBy("game_pk").collect()
    b = ratings.elo_entering(games(spark, more)).orderBy("game_pk").limit(5).collect()
    assert a == b


def test_leagues_are_rated_apart(spark):
    rng = random.Random(1)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), f"t{rng.randrange(4)}",
             f"u{rng.randrange(4)}", float(rng.randrange(2)), f"L{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "game_pk long, game_date date, home_team string, "
                                     "away_team string, home_win double, league string")
    whole = {r["game_pk"]: r["home_elo"] for r in ratings.elo_entering(df, "league").collect()}
    for lg in ("L0", "L1", "L2"):
        for r in ratings.elo_entering(df.where(df.league == lg)).collect():
            assert whole[r["game_pk"]] == r["home_elo"]
    assert len(whole) == 90


def test_seasons_and_resumption_give_the_same_ratings(spark):
    rng = random.Random(8)
    rows = [((dt.date(2023, 4, 1) + dt.timedelta(days=5 * i)).isoformat(), f"t{rng.randrange(4)}",
             f"u{rng.randrange(4)}", rng.choice([0, 1, None]), 1, 0) for i in range(200)]
    g = games(spark, rows).selectExpr("*", "cast(game_date as timestamp_ntz) start_time_utc")
    want = {r["game_pk"]: (r["home_elo"], r["away_elo"]) for r in
            ratings.elo_entering(g).collect()}
    by_season = ratings.elo_by_season(g, Stage(spark))
    assert {r["game_pk"]: (r["home_elo"], r["away_elo"]) for r in by_season.collect()} == want
    cut = dt.datetime(2024, 8, 1)
    later = ratings.elo_entering(g.where(g.start_time_utc >= cut),
                                 initial=ratings.elo_as_of(g, cut)).collect()
    assert later and all(want[r["game_pk"]] == (r["home_elo"], r["away_elo"]) for r in later)


def entering(spark, rows):
    return {(r["game_pk"], r["side"]): r for r in
            ratings.records_entering(games(spark, rows)).collect()}


def test_records_reset_and_opener_rate_is_null(spark):
    got = entering(spark, SEASONS)
    opener = got[(4, "home")]
    assert (opener["record"], opener["win_pct"], opener["run_diff"]) == ("0-0", None, 0)
    second = got[(1, "home")]
    assert (second["record"], second["run_diff"], second["win_pct"]) == ("1-0", 2, 1.0)


def test_records_flag_for_zero(spark):
    out = ratings.records_entering(games(spark, SEASONS), zero_for_no_games=True)
    assert out.where("game_pk = 0 and win_pct <> 0").count() == 0


def test_records_with_split_seasons(spark):
    rng = random.Random(3)
    rows = [((dt.date(2024, 4, 1) + dt.timedelta(days=i // 2)).isoformat(), "H",
             f"t{rng.randrange(5)}", rng.choice([0, 1, None]), 3, 2) for i in range(300)]
    g = games(spark, rows)
    split = hot_split(g.selectExpr(
        "home_team as team", "year(game_date) as season", "game_date"),
                      ["team", "season"], day_of("game_date"), 50)
    a = ratings.records_entering(g).collect()
    b = ratings.records_entering(g, split).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_final_records_cover_only_the_latest_season(spark):
    got = {r["team"]: (r["wins"], r["losses"], r["runs_scored"], r["runs_allowed"])
           for r in ratings.final_records(games(spark, SEASONS[:4])).collect()}
    assert got == {"BOS": (2, 0, 13, 5), "SEA": (0, 2, 3, 6), "NYY": (1, 1, 3, 8)}
    got = {r["team"] for r in ratings.final_records(games(spark, SEASONS)).collect()}
    assert got == {"BOS", "SEA"}


def test_power_rankings_skip_undecided(spark):
    g = games(spark, [("2026-04-01", "BOS", "NYY", 1, 5, 3), ("2026-04-02", "BOS", "NYY", 1, 4, 2),
                      ("2026-04-03", "LAD", "BOS", None, None, None),
                      ("2026-04-04", "NYY", "LAD", None, None, None)])
    g = g.selectExpr("*", "cast(1500 + game_pk as double) as home_elo")
    got = {r["team"]: r for r in ratings.power_rankings(g).collect()}
    assert (got["BOS"]["record"], got["BOS"]["l10"]) == ("2-0", "2-0")
    assert (got["LAD"]["record"], got["LAD"]["pct"], got["LAD"]["l10"]) == ("0-0", 0.0, "0-0")
    assert got["BOS"]["away_pct"] == 0.5 and got["NYY"]["home_pct"] == 0.0
    assert [got[t]["rank"] for t in ("NYY", "LAD", "BOS")] == [1, 2, 3]
    assert got["BOS"]["elo"] == 1500.5 and got["BOS"]["elo_latest"] == 1501.0


def test_last_played(spark):
    got = {r["team"]: r["last_played"].isoformat() for r in
           ratings.last_played(games(spark, SEASONS)).collect()}
    assert got == {"BOS": "2026-03-17", "SEA": "2026-03-17", "NYY": "2025-04-04"}


def test_games_without_a_date_keep_their_ratings_by_season(spark):
    df = games(spark, SEASONS).withColumn(
        "game_date", F.when(F.col("game_pk") != 2, F.col("game_date")))
    want = sorted(map(tuple, ratings.elo_entering(df).collect()))
    got = sorted(map(tuple, ratings.elo_by_season(df, Stage(spark)).collect()))
    assert got == want and len(got) == len(SEASONS)


def test_a_league_column_is_required(spark):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        ratings.elo_entering(games(spark, SEASONS).drop("league")).collect()
