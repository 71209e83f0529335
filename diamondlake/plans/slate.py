"""Pre-game rows for a day's schedule, carried forward from strictly earlier games."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import ratings
from diamondlake.operators.prior import latest_values

_ORDER = ["game_date", "game_pk"]


def _bases(columns) -> list[str]:
    return list(dict.fromkeys(c.rsplit("_", 1)[0] for c in columns
                              if c.endswith(("_home", "_away"))))


def _both_sides(history: DataFrame, ids: tuple[str, str], bases: list[str]) -> DataFrame:
    """(entity, order, base columns) from home and away columns."""
    def side(name, id_col):
        return F.struct(F.col(id_col).alias("entity"), *[
            (F.col(f"{b}_{name}") if f"{b}_{name}" in history.columns
             else F.lit(None)).cast("double").alias(b) for b in bases])

    return history.select(*_ORDER, F.inline(F.array(side("home", ids[0]), side("away", ids[1]))))


def team_state(history: DataFrame, columns=None) -> DataFrame:
    """(team, base…): each team's latest value of every side feature, wherever it played."""
    carried = columns or [c for c in K.FEATURES
                          if not c.startswith(("sp_", "opp_lefty_share", "rest_days"))]
    bases = _bases([c for c in carried if c in history.columns])
    rows = _both_sides(history, ("home_team", "away_team"), bases)
    return latest_values(rows, "entity", _ORDER, bases).withColumnRenamed("entity", "team")


def pitcher_state(history: DataFrame) -> DataFrame:
    """(pitcher, base…): each starter's latest value of every sp_ feature, on either side."""
    numeric = [f.name for f in history.schema.fields if isinstance(f.dataType, T.NumericType)]
    bases = _bases([c for c in numeric if c.startswith("sp_")])
    rows = _both_sides(history, ("home_starter_id", "away_starter_id"), bases)
    return latest_values(rows, "entity", _ORDER, bases).withColumnRenamed("entity", "pitcher")


def own_lefty_share(history: DataFrame) -> DataFrame:
    """(team, share) of the team's own lineup; the value from its away games takes precedence."""
    rows = history.select(*_ORDER, F.inline(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("opp_lefty_share_away").alias("_at_home"),
                 F.lit(None).cast("double").alias("_away")),
        F.struct(F.col("away_team").alias("team"), F.lit(None).cast("double").alias("_at_home"),
                 F.col("opp_lefty_share_home").alias("_away")))))
    return (latest_values(rows, "team", _ORDER, ["_at_home", "_away"])
            .select("team", F.coalesce("_away", "_at_home").alias("lefty_share")))


def name_crosswalk(pitches: DataFrame, order=("game_date", "game_pk", "pitcher")) -> DataFrame:
    """(name_key, pitcher): the latest id per normalised name."""
    named = (pitches.where(F.col("player_name").isNotNull() & F.col("pitcher").isNotNull())
             .withColumn("name_key", S.player_key("player_name"))
             .where(F.col("name_key") != ""))
    have = [c for c in order if c in named.columns]
    return named.groupBy("name_key").agg(
        F.max_by("pitcher", F.struct(*have)).alias("pitcher"))


def build_upcoming_slate(history: DataFrame, day: date, schedule: DataFrame,
                         crosswalk: DataFrame | None = None, league: str = "league",
                         zero_for_no_games: bool = False) -> DataFrame:
    """One row per scheduled game with every model feature; unknown ones are NULL.

    Only games before `day` are read from the history, whatever it holds. The games of the day come ordered by
    start time, unknown times last, then by id.
    Results already in the schedule are kept. Ratings belong to (league, team) where the schedule names
    the league; without it, a team's name must be of one league. Rest days are fresh, the rest is the latest state.
    """
    if "start_time_utc" not in history.columns:
        history = history.withColumn("start_time_utc",
                                     F.col("game_date").cast("timestamp_ntz"))
    if "game_pk" not in history.columns:
        history = history.withColumn("game_pk", F.col("game_id"))
    d = F.lit(day).cast("date")
    history = history.where(F.col("game_date") < d)
    elo = (ratings.elo_as_of(history, d.cast("timestamp_ntz"), league=league)
           .select(F.col("league").alias("_league"), F.col("team").alias("_team"), "elo"))
    by_league = league in schedule.columns
    teams = (team_state(history)
             .join(ratings.final_records(history), "team", "full")
             .join(ratings.last_played(history), "team", "full"))
    if {"opp_lefty_share_home", "opp_lefty_share_away"} <= set(history.columns):
        teams = teams.join(own_lefty_share(history), "team", "full")
    else:
        teams = teams.withColumn("lefty_share", F.lit(None).cast("double"))

    def text(name, default):
        return (F.coalesce(F.col(name), F.lit(default)) if name in schedule.columns
                else F.lit(default)).alias(name)

    def given(name, kind):
        return (F.col(name) if name in schedule.columns else F.lit(None)).cast(kind).alias(name)

    made_id = S.game_id(d, "away_team", "home_team")
    slate = schedule.select(
        (F.coalesce("game_id", made_id) if "game_id" in schedule.columns else made_id)
        .alias("game_id"), d.alias("game_date"), given("start_time_utc", "timestamp_ntz"),
        "home_team", "away_team", text("venue", "Unknown"), given("home_win", "double"),
        given("home_score", "int"), given("away_score", "int"),
        text("sp_name_home", "TBD"), text("sp_name_away", "TBD"),
        *([F.col(league).cast("string").alias("_of_league")] if by_league else []))

    carried = [c for c in teams.columns if c not in (
        "team", "wins", "losses", "runs_scored", "runs_allowed", "last_played",
        "lefty_share")]
    starters = pitcher_state(history) if "home_starter_id" in history.columns else None
    for side, other in (("home", "away"), ("away", "home")):
        wins, losses = F.coalesce("wins", F.lit(0)), F.coalesce("losses", F.lit(0))
        pct = S.half_even(S.ratio(wins, wins + losses), 3)
        state = teams.select(
            F.col("team").alias(f"{side}_team"),
            wins.alias(f"{side}_wins"), losses.alias(f"{side}_losses"),
            (F.coalesce("runs_scored", F.lit(0)) - F.coalesce("runs_allowed", F.lit(0)))
            .alias(f"{side}_run_diff"),
            pct.alias(f"{side}_win_pct"),
            S.rest_days_to(d, "last_played").alias(f"rest_days_{side}"),
            F.col("lefty_share").alias(f"opp_lefty_share_{other}"),
            *[F.col(c).alias(f"{c}_{side}") for c in carried])
        slate = slate.join(state, f"{side}_team", "left")
        rated = F.col(f"{side}_team") == F.col("_team")
        if by_league:
            rated &= F.col("_of_league").eqNullSafe(F.col("_league"))
        slate = slate.join(elo.withColumnRenamed("elo", f"{side}_elo"), rated, "left").drop("_league", "_team")
        no_games = F.lit(0.0) if zero_for_no_games else F.lit(None).cast("double")
        slate = slate.withColumns({
            f"{side}_wins": F.coalesce(f"{side}_wins", F.lit(0)),
            f"{side}_losses": F.coalesce(f"{side}_losses", F.lit(0)),
            f"{side}_run_diff": F.coalesce(f"{side}_run_diff", F.lit(0)),
            f"{side}_win_pct": F.coalesce(f"{side}_win_pct", no_games),
            f"{side}_elo": F.coalesce(f"{side}_elo", F.lit(K.ELO_START))})
        slate = slate.withColumn(f"{side}_record",
                                 S.record_label(f"{side}_wins", f"{side}_losses"))
        if crosswalk is not None and starters is not None:
            ids = crosswalk.select(F.col("name_key").alias("_key"),
                                   F.col("pitcher").cast("double").alias("_pid"))
            lines = starters.select(F.col("pitcher").cast("double").alias("_line_pid"), *[
                F.col(c).alias(f"{c}_{side}") for c in starters.columns if c != "pitcher"])
            slate = (slate.join(ids, S.player_key(f"sp_name_{side}") == F.col("_key"), "left")
                     .join(lines, F.col("_pid") == F.col("_line_pid"), "left")
                     .drop("_key", "_pid", "_line_pid"))
    slate = slate.drop("_of_league")
    missing = {c: F.lit(None).cast("double") for c in K.FEATURES if c not in slate.columns}
    slate = slate.withColumns(missing) if missing else slate
    return slate.orderBy(F.asc_nulls_last("start_time_utc"), "game_id")
