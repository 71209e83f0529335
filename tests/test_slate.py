import datetime as dt

import pytest
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.plans import slate

HISTORY = ("game_id string, game_pk long, game_date date, start_time_utc timestamp_ntz, "
           "home_team string, away_team string, home_win double, home_score int, away_score int, "
           "home_starter_id double, away_starter_id double, woba_30g_home double, "
           "woba_30g_away double, opp_lefty_share_home double, opp_lefty_share_away double, "
           "rest_days_home int, sp_era_30g_home double, sp_era_30g_away double, "
           "sp_era_home double, sp_k9_30g_home double")
TODAY = dt.date(2026, 8, 22)


def game(pk, day, home, away, win, hs, as_, hp, ap, wh, wa, lh, la, eh, ea, era, k9):
    d = dt.date(2026, 8, day)
    start = dt.datetime(2026, 8, day, 19)
    return (f"{d:%Y%m%d}_{away}@{home}", pk, d, start, home, away, win, hs, as_, hp, ap, wh, wa,
            lh, la, 9, eh, ea, era, k9)


@pytest.fixture(scope="module")
def built(spark):
    history = spark.createDataFrame([
        game(1, 18, "NYY", "SEA", 1.0, 5, 2, 10.0, 20.0, .320, .310, .40, .44, 4.0, 3.9, 3.0, 9.0),
        game(2, 20, "SEA", "BOS", 0.0, 1, 3, 21.0, 30.0, None, .300, .50, .46, None, 5.0, None,
             None),
        game(3, 21, "NYY", "BOS", 1.0, 6, 2, 10.0, 31.0, .340, .305, None, None, 4.5, None, 3.1,
             9.9),
    ], HISTORY)
    schedule = spark.createDataFrame(
        [("NYY", "SEA", dt.datetime(2026, 8, 22, 23), "Gerrit Cole", "George Kirby", "Park"),
         ("LAD", "BOS", dt.datetime(2026, 8, 22, 20), "TBD", "Nobody Known", None)],
        "home_team string, away_team string, start_time_utc timestamp_ntz, sp_name_home string, "
        "sp_name_away string, venue string")
    pitches = spark.createDataFrame([("Cole, Gerrit", 10), ("KIRBY,  George", 20), (None, 5)],
                                    "player_name string, pitcher long")
    out = slate.build_upcoming_slate(history.withColumn('league', F.lit('one')), TODAY, schedule, slate.name_crosswalk(pitches))
    return {r["home_team"]: r.asDict() for r in out.collect()}


def test_ratings_of_teams_of_equal_names_by_league(spark):
    day = dt.date(2026, 8, 20)
    rows = [(1, day, "A", "B", 1.0, 3, 1, "x"), (2, day, "A", "B", 0.0, 1, 3, "y"), (3, day, "A", "B", 0.0, 1, 3, None)]
    history = spark.createDataFrame(rows, "game_pk long, game_date date, home_team string, away_team string, "
                                    "home_win double, home_score int, away_score int, league string")
    history = history.selectExpr("*", "0.3 as woba_30g_home", "0.3 as woba_30g_away")
    schedule = spark.createDataFrame([(f"g{lg}", "A", "B", lg) for lg in ("x", "y", None, "new")],
                                     "game_id string, home_team string, away_team string, league string")
    out = {r["game_id"]: r for r in slate.build_upcoming_slate(history, TODAY, schedule).collect()}
    assert len(out) == 4 and out["gx"]["home_elo"] > K.ELO_START > out["gy"]["home_elo"] == out["gNone"]["home_elo"]
    assert out["gx"]["away_elo"] < K.ELO_START < out["gy"]["away_elo"] and out["gnew"]["home_elo"] == K.ELO_START
    assert "league" not in out["gx"].asDict()


def test_one_row_per_scheduled_game_with_every_feature(built):
    assert list(built) == ["LAD", "NYY"]        # in order of their start
    assert set(K.FEATURES) <= set(built["NYY"])
    assert built["NYY"]["game_id"] == "20260822_SEA@NYY"
    assert built["NYY"]["home_win"] is None and built["NYY"]["home_score"] is None
    assert built["LAD"]["venue"] == "Unknown"


def test_records_and_run_difference(built):
    g = built["NYY"]
    assert (g["home_record"], g["home_run_diff"], g["home_win_pct"]) == ("2-0", 7, 1.0)
    assert (g["away_record"], g["away_win_pct"]) == ("0-2", 0.0)
    assert (built["LAD"]["home_record"], built["LAD"]["home_win_pct"]) == ("0-0", None)


def test_latest_team_values_from_either_side(built):
    assert built["NYY"]["woba_30g_home"] == 0.340
    assert built["NYY"]["woba_30g_away"] == 0.310  # SEA was last observed on the road
    assert built["LAD"]["woba_30g_away"] == 0.305


def test_lefty_share_is_mirrored_with_away_precedence(built):
    # NYY's own lineup faced the away starter at home; SEA's newer home value loses
    assert built["NYY"]["opp_lefty_share_away"] == 0.44
    assert built["NYY"]["opp_lefty_share_home"] == 0.40


def test_pitchers_are_found_by_name(built):
    g = built["NYY"]
    assert (g["sp_era_30g_home"], g["sp_era_home"], g["sp_k9_30g_home"]) == (4.5, 3.1, 9.9)
    assert g["sp_era_30g_away"] == 3.9
    assert built["LAD"]["sp_era_30g_home"] is None


def test_rest_days_are_fresh(built):
    assert (built["NYY"]["rest_days_home"], built["NYY"]["rest_days_away"]) == (1, 2)
    assert built["LAD"]["rest_days_home"] is None


def test_elo_entering(built):
    assert built["NYY"]["home_elo"] > 1500 and built["LAD"]["home_elo"] == 1500


def test_zero_flag(spark):
    empty = spark.createDataFrame([], HISTORY)
    schedule = spark.createDataFrame([("A", "B")], "home_team string, away_team string")
    got = slate.build_upcoming_slate(empty.withColumn('league', F.lit('one')), TODAY, schedule, zero_for_no_games=True).first()
    assert got["home_win_pct"] == 0.0 and got["home_record"] == "0-0"
    assert slate.build_upcoming_slate(empty.withColumn('league', F.lit('one')), TODAY, schedule.limit(0)).count() == 0


def test_games_of_the_day_and_after_are_not_seen(spark, built):
    past = [game(1, 18, "NYY", "SEA", 1.0, 5, 2, 10.0, 20.0, .320, .310, .40, .44, 4.0, 3.9, 3.0, 9.0)]
    later = [game(8, 22, "NYY", "SEA", 0.0, 0, 9, 10.0, 20.0, .1, .1, .1, .1, 9.0, 9.0, 9.0, 1.0),
             game(9, 25, "SEA", "NYY", 1.0, 9, 0, 20.0, 10.0, .1, .1, .1, .1, 9.0, 9.0, 9.0, 1.0)]
    schedule = spark.createDataFrame([("NYY", "SEA")], "home_team string, away_team string")
    rows = [slate.build_upcoming_slate(
        spark.createDataFrame(h, HISTORY).withColumn("league", F.lit("one")), TODAY, schedule).collect()
        for h in (past, past + later)]
    assert rows[0] == rows[1] and rows[0][0]["home_record"] == "1-0"
