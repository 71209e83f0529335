"""One row per game with both sides' point-in-time features, and one row per pitch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.functions import scalars as S
from diamondlake.operators import appearances as A
from diamondlake.operators import ratings
from diamondlake.operators.prior import (HOT_ROWS, Split, day_of, hot_split, load_before,
                                         running)
from diamondlake.session import Stage

PITCHER_FEATURES = ["sp_era", "sp_k9", "sp_bb9", "sp_whip", "sp_fip", "sp_xwoba",
                    "sp_fbvelo_3g", "sp_fbpct_3g", "sp_whiff_3g", "sp_xwoba_vs_l",
                    "sp_xwoba_vs_r"]
TEAM_FEATURES = ["team_woba_30g", "team_iso_30g", "team_k_rate_30g", "team_bb_rate_30g",
                 "bullpen_whip_10g", "bullpen_era_10g", "team_barrel_15g", "team_hardhit_15g",
                 "team_exitvelo_15g", "bullpen_pitches_3d", "bullpen_ip_3d",
                 "lineup_woba_mean", "lineup_woba_top3", "lineup_woba_std", "rest_days"]
# pitch columns that the game frame is built from
GAME_INPUT = ["game_pk", "game_date", "home_team", "away_team", "inning", "inning_topbot",
              "at_bat_number", "pitch_number", "pitcher", "batter", "stand", "pitch_type",
              "release_speed", "description", "events", "launch_speed", "launch_angle",
              "estimated_woba_using_speedangle", "home_score", "away_score"]
# and those that only the situation of a pitch needs
SITUATION_INPUT = ["on_1b", "on_2b", "on_3b", "p_throws"]
# game columns that every pitch row carries
PITCH_ROW_FEATURES = ["home_win", "total_runs", "venue"] + [
    f"{c}_{side}" for c in ("rest_days", "sp_era", "sp_k9", "sp_bb9", "sp_whip", "sp_fip",
                            "sp_xwoba", "team_woba_30g", "team_iso_30g", "team_k_rate_30g",
                            "team_bb_rate_30g", "bullpen_whip_10g", "bullpen_era_10g")
    for side in ("home", "away")]


def bullpen_load(games: DataFrame, days: DataFrame, window: int = 3) -> DataFrame:
    """Per team and game: relief pitches and innings over the days before."""
    rows = A.team_games(games).select("game_pk", "game_date", "team")
    out = load_before(rows, days, "team", "game_date", "day", window,
                      {"bullpen_pitches_3d": "pitches", "_outs": "outs"})
    return out.select("game_pk", "team", "bullpen_pitches_3d",
                      (F.col("_outs") / F.lit(3.0)).alias("bullpen_ip_3d"))


def assemble(games: DataFrame, team_frames: list[DataFrame],
             pitcher_frames: list[DataFrame]) -> DataFrame:
    """Side rows joined to their team's and starter's figures, then folded to one row per game.

    All joins use (game, team) or (game, pitcher); the lefty share goes to the opposing side,
    since it describes the lineup that side's starter faces. A frame has a row or so per key, so
    its part of a task is hashed and the side rows, wider with each join, are never sorted.
    """
    def with_frame(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        return a.join(b.drop("game_date").hint("shuffle_hash"), ["game_pk", key], "left")

    sides = A.team_games(games, "home_starter_id", "away_starter_id").select(
        "game_pk", "side", "team",
        F.when(F.col("side") == "home", F.col("home_starter_id"))
         .otherwise(F.col("away_starter_id")).alias("pitcher"))
    by_team = reduce(lambda a, b: with_frame(a, b, "team"), team_frames, sides)
    full = reduce(lambda a, b: with_frame(a, b, "pitcher"), pitcher_frames, by_team)
    names = {c: c + "_{side}" for c in PITCHER_FEATURES + TEAM_FEATURES if c in full.columns}
    if "lineup_lefty_share_30g" in full.columns:
        names["lineup_lefty_share_30g"] = "opp_lefty_share_{other}"
    return games.join(ratings.sides_to_columns(full, names), "game_pk", "left")


def pa_split(pitches: DataFrame, hot_rows: int = HOT_ROWS) -> Split | None:
    """Games with an extreme number of plate appearances."""
    return hot_split(pitches.where(S.ends_plate_appearance()), ["game_pk"],
                     F.col("at_bat_number"), hot_rows)


def build_game_features(pitches: DataFrame, stage: Stage | None = None,
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """The full game frame from a conformed pitch log.

    The per-(game, half, pitcher) aggregate, its sums per team, the game frame and the batter rows
    feed several branches, so they are written once to the shared folder. Keys with more than `hot_rows` rows
    get their windows cut into ranges of dates.
    """
    stage = stage or Stage(pitches.sparkSession)
    base = stage.put("game_half_pitcher", A.game_half_pitcher(pitches))
    games = stage.put("games", A.game_results(pitches))
    batters = stage.put("batter_games", A.batter_games(pitches))
    by_day = day_of("game_date")
    pitcher_split = hot_split(base, ["pitcher"], by_day, hot_rows)
    batter_split = hot_split(batters, ["batter"], by_day, hot_rows)
    team_split = hot_split(A.team_games(games), ["team"], by_day, hot_rows)

    relief = A.relievers(base, games)
    relieved = stage.put("relief_sums", A.relief_sums(relief))
    batted = stage.put("batting_sums", A.batting_sums(base))
    form = stage.put("batter_form", A.batter_form(batters, split=batter_split))
    lineups = A.lineups(A.batter_ratings(form, A.league_mean(form)))
    team_frames = [
        A.rest_days(games, team_split),
        A.team_batting_form(A.team_batting(base, batted), split=team_split),
        A.team_contact_form(A.team_contact(base, batted), split=team_split),
        A.bullpen_form(A.bullpen_games(relief, relieved), split=team_split),
        bullpen_load(games, A.bullpen_days(relief, relieved)),
        lineups,
    ]
    pitcher_frames = [
        A.pitcher_rates(A.pitcher_games(A.plate_appearances(
            pitches, pa_split(pitches, hot_rows))), split=pitcher_split),
        A.pitcher_stuff_form(A.pitcher_stuff(base), split=pitcher_split),
    ]
    return assemble(games, team_frames, pitcher_frames)


def enrich_games(games: DataFrame, league: str = "league", stage: Stage | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Entering Elo, records, win rate and run difference for both sides.

    With a stage the ratings are computed season by season.
    """
    elo = (ratings.elo_by_season(games, stage, league) if stage
           else ratings.elo_entering(games, league))
    split = hot_split(A.team_games(games, "season"), ["team", "season"], day_of("game_date"), hot_rows)
    rec = ratings.sides_to_columns(ratings.records_entering(games, split), {
        "wins": "{side}_wins", "losses": "{side}_losses", "win_pct": "{side}_win_pct",
        "run_diff": "{side}_run_diff", "record": "{side}_record"})
    return games.join(elo, "game_pk", "left").join(rec, "game_pk", "left")


def situational_columns(pitches: DataFrame, split: Split | None = None) -> DataFrame:
    """Base state, score, matchup, pitch count in the at-bat and pitch family per pitch."""
    pitches = running(pitches.withColumn("_one", F.lit(1)), ["game_pk", "at_bat_number"],
                      ["pitch_number"], {"_earlier": "_one"}, split)
    risp = S.occupied("on_2b", "on_3b")
    return pitches.withColumns({
        "bases_loaded": S.occupied("on_1b", "on_2b", "on_3b"),
        "runners_in_scoring_position": risp,
        "is_risp": risp > 0,
        "score_diff": F.coalesce("home_score", F.lit(0)) - F.coalesce("away_score", F.lit(0)),
        "batting_team": S.batting_team(),
        "ab_pitch_count": (F.coalesce("_earlier", F.lit(0)) + 1).cast("int"),
        "times_through_order": F.ceil(F.col("at_bat_number") / F.lit(9.0)).cast("int"),
        "lr_matchup": F.when(F.col("stand") == F.col("p_throws"), "same").otherwise("opposite"),
        "exit_velocity": F.col("launch_speed"),
        "launch_angle_f": F.col("launch_angle"),
        "pitch_category": S.pitch_category(),
        **{new: F.col(old) for old, new in (("barrel", "is_barrel"),
                                            ("hard_contact", "is_hard_hit"))
           if old in pitches.columns},
    }).drop("_one", "_earlier")


def build_pitch_features(pitches: DataFrame, games: DataFrame,
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every pitch with its situation and its game's features.

    The join and the at-bat window share the partitioning by game, and AQE broadcasts the game
    side only if its measured size allows.
    """
    have = [c for c in PITCH_ROW_FEATURES if c in games.columns]
    joined = pitches.join(games.select("game_pk", *have), "game_pk", "left")
    split = hot_split(pitches, ["game_pk", "at_bat_number"], F.col("pitch_number"), hot_rows)
    return situational_columns(joined, split)


PITCH_ORDER = ["game_date", "game_pk", "inning", "at_bat_number", "pitch_number"]
