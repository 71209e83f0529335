"""Sequential team ratings (Elo), season records and rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators.appearances import team_games
from diamondlake.operators.prior import Split, filter_prior, running
from diamondlake.session import Stage

# --- Elo -------------------------------------------------------------------------------------------

_FOLDED = ("kind string, league string, season int, game_pk {pk}, team string, "
           "home_elo double, away_elo double")


def _fold(games: DataFrame, league: str, initial: DataFrame | None, k: float,
          advantage: float, start: float, revert: float) -> DataFrame:
    """Play each league's games in order; rows of kind 'game' (ratings entering it) and, at the
    end, of kind 'state' (rating of each team).

    A rating depends on every earlier game of its league, so a league is one ordered stream of
    narrow rows (external sort, spills to disk) that arrives in Arrow batches and is never
    gathered; leagues run in parallel. `league` names the column that says who can meet whom, so a
    group is as large as one competition, however many there are. Rows of `initial` precede the
    games and set the state.
    """
    pk = games.schema["game_pk"].dataType.simpleString()
    rows = games.select(
        F.col(league).cast("string").alias("league"),
        F.year("game_date").alias("season"), "game_date", "game_pk",
        "home_team", "away_team", F.col("home_win").cast("double").alias("value"),
        F.lit(False).alias("is_seed"))
    if initial is not None:  # no date: sorts first
        rows = rows.unionByName(initial.select(
            "league", "season", F.lit(None).cast("date").alias("game_date"),
            F.lit(None).cast(pk).alias("game_pk"), F.col("team").alias("home_team"),
            F.lit(None).cast("string").alias("away_team"), F.col("elo").alias("value"),
            F.lit(True).alias("is_seed")))
    ordered = rows.repartition("league").sortWithinPartitions("league", "game_date", "game_pk")

    class Ratings:
        """Ratings of one league while its games stream by; memory grows with teams, not games.

        Defined here so that it travels with the function: workers need no copy of the package.
        """

        def __init__(self):
            self.elo, self.season = {}, None

        def play(self, season, home, away, home_win):
            if self.season is not None and season != self.season:
                self.elo = {t: e + revert * (start - e) for t, e in self.elo.items()}
            self.season = season
            h, a = self.elo.get(home, start), self.elo.get(away, start)
            if home_win == home_win and home_win is not None:  # undecided games change nothing
                expected = 1.0 / (1.0 + 10 ** ((a - h - advantage) / 400))
                self.elo[home] = h + k * (home_win - expected)
                self.elo[away] = a + k * ((1 - home_win) - (1 - expected))
            return h, a

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def final():
            n = len(state.elo)
            return pd.DataFrame({
                "kind": ["state"] * n, "league": [current] * n, "season": [state.season] * n,
                "game_pk": [None] * n, "team": list(state.elo),
                "home_elo": list(state.elo.values()), "away_elo": [None] * n})

        for batch in batches:
            games_of, entry = [], []
            for i, (lg, season, home, away, value, seed) in enumerate(zip(
                    batch["league"], batch["season"], batch["home_team"], batch["away_team"],
                    batch["value"], batch["is_seed"])):
                if state is None or lg != current:
                    if state is not None and state.elo:
                        yield final()
                    current, state = lg, Ratings()
                if seed:
                    state.elo[home], state.season = value, season
                else:
                    games_of.append(i)
                    entry.append(state.play(season, home, away, value))
            played = batch.iloc[games_of]
            yield pd.DataFrame({
                "kind": "game", "league": played["league"], "season": played["season"],
                "game_pk": played["game_pk"], "team": None,
                "home_elo": [e[0] for e in entry], "away_elo": [e[1] for e in entry]})
        if state is not None and state.elo:
            yield final()

    return ordered.mapInPandas(play, _FOLDED.format(pk=pk))


def _entering(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'game'").select("game_pk", "home_elo", "away_elo")


def _state(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'state'").select("league", "season", "team",
                                                 F.col("home_elo").alias("elo"))


def elo_entering(games: DataFrame, league: str = "league", initial: DataFrame | None = None,
                 k: float = K.ELO_K, advantage: float = K.ELO_HOME_ADVANTAGE,
                 start: float = K.ELO_START, revert: float = K.ELO_REVERT) -> DataFrame:
    """(game_pk, home_elo, away_elo) as both teams enter the game.

    With `initial`, a rating table as `elo_as_of` returns it, only games after it are read.
    """
    return _entering(_fold(games, league, initial, k, advantage, start, revert))


def elo_as_of(games: DataFrame, as_of, time_col: str = "start_time_utc",
              league: str = "league", initial: DataFrame | None = None, k: float = K.ELO_K,
              advantage: float = K.ELO_HOME_ADVANTAGE, start: float = K.ELO_START,
              revert: float = K.ELO_REVERT) -> DataFrame:
    """(league, season, team, elo) after all games that start before `as_of`."""
    return _state(_fold(filter_prior(games, as_of, time_col), league, initial, k, advantage,
                        start, revert))


def elo_by_season(games: DataFrame, stage: Stage, league: str = "league",
                  k: float = K.ELO_K, advantage: float = K.ELO_HOME_ADVANTAGE,
                  start: float = K.ELO_START, revert: float = K.ELO_REVERT) -> DataFrame:
    """`elo_entering`, one season at a time.

    No task gets more than one season of a league. Each season is written with the ratings it ends
    on, which the next one starts from, so a lost executor costs at most one season. Games without
    a date come first, as in `elo_entering`.
    """
    found = [r[0] for r in games.select(F.year("game_date")).distinct().collect()]
    years = sorted(found, key=lambda y: (y is not None, y))  # one number per calendar year
    parts, state = [], None
    for y in years:
        day = F.col("game_date")
        season = games.where(day.isNull() if y is None else day.between(
            F.lit(f"{y}-01-01").cast("date"), F.lit(f"{y}-12-31").cast("date")))
        folded = stage.put(f"elo_{y}", _fold(season, league, state, k, advantage, start, revert))
        parts.append(_entering(folded))
        state = _state(folded)
    if not parts:
        return elo_entering(games, league)
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- season records --------------------------------------------------------------------------------

def _result_rows(games: DataFrame) -> DataFrame:
    """Team-game rows with what the game adds to the team's record; zeros while undecided."""
    rows = team_games(games, "home_win", "home_score", "away_score")
    home = F.col("side") == "home"
    decided = F.col("home_win").isNotNull()
    won = F.when(home, F.col("home_win")).otherwise(1 - F.col("home_win"))
    scored = F.when(home, F.col("home_score")).otherwise(F.col("away_score"))
    allowed = F.when(home, F.col("away_score")).otherwise(F.col("home_score"))

    def when_decided(c):
        return F.when(decided, F.coalesce(c.cast("bigint"), F.lit(0))).otherwise(F.lit(0))

    return rows.withColumns({
        "season": F.year("game_date"),
        "w": when_decided(won), "l": when_decided(1 - won),
        "rs": when_decided(scored), "ra": when_decided(allowed), "decided": decided})


def records_entering(games: DataFrame, split: Split | None = None,
                     zero_for_no_games: bool = False) -> DataFrame:
    """Per side: season record, win rate and run difference before the game.

    The rate is NULL before the first decided game of a season.
    """
    out = running(_result_rows(games), ["team", "season"], ["game_date", "game_pk", "side"],
                  {"wins": "w", "losses": "l", "_rs": "rs", "_ra": "ra"}, split)
    wins, losses = F.coalesce("wins", F.lit(0)), F.coalesce("losses", F.lit(0))
    pct = S.half_even(S.ratio(wins, wins + losses), 3)
    return out.select(
        "game_pk", "side", "team", wins.alias("wins"), losses.alias("losses"),
        (F.coalesce(pct, F.lit(0.0)) if zero_for_no_games else pct).alias("win_pct"),
        (F.coalesce("_rs", F.lit(0)) - F.coalesce("_ra", F.lit(0))).alias("run_diff"),
        S.record_label(wins, losses).alias("record"))


def sides_to_columns(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fold side rows into one row per game; `names` maps a column to a pattern with {side}, the
    row's own side, or {other}.

    A game has one row per side, which is carried as one struct: two aggregate functions instead
    of two per column keep the generated code small.
    """
    row = F.struct(*names)
    folded = frame.groupBy("game_pk").agg(*[
        F.first(F.when(F.col("side") == side, row), ignorenulls=True).alias(f"_{side}")
        for side in ("home", "away")])
    return folded.select("game_pk", *[
        F.col(f"_{side}")[c].alias(pattern.format(side=side, other=other))
        for c, pattern in names.items() for side, other in (("home", "away"), ("away", "home"))])


def final_records(games: DataFrame) -> DataFrame:
    """Record per team in the latest season with a decided game."""
    decided = _result_rows(games.where(F.col("home_win").isNotNull()))
    latest = decided.agg(F.max("season").alias("_latest"))  # one row
    return (decided.join(F.broadcast(latest), F.col("season") == F.col("_latest"))
            .groupBy("team").agg(F.sum("w").alias("wins"), F.sum("l").alias("losses"),
                                 F.sum("rs").alias("runs_scored"),
                                 F.sum("ra").alias("runs_allowed")))


def last_played(games: DataFrame) -> DataFrame:
    return team_games(games).groupBy("team").agg(F.max("game_date").alias("last_played"))


def last_results(games: DataFrame, n: int = 10) -> DataFrame:
    """Wins and losses over the last `n` decided games of each team."""
    rows = _result_rows(games.where(F.col("home_win").isNotNull()))
    w = Window.partitionBy("team").orderBy(F.desc("game_date"), F.desc("game_pk"))
    return (rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
            .groupBy("team").agg(F.sum("w").alias("l10_wins"), F.sum("l").alias("l10_losses")))


def power_rankings(games: DataFrame, elo: str = "home_elo") -> DataFrame:
    """Record, rates, last ten and rank per home team.

    `elo` is the mean rating over home games, `elo_latest` the one entering the last home game.
    Undecided games count for neither side. Ranking is over one row per team.
    """
    rows = _result_rows(games)
    at_home = F.col("side") == "home"
    sums = rows.groupBy("team").agg(
        F.sum("w").alias("wins"), F.sum("l").alias("losses"),
        F.sum(F.when(at_home, F.col("w"))).alias("_hw"),
        F.sum(S.flag(at_home & F.col("decided"))).alias("_hn"),
        F.sum(F.when(~at_home, F.col("w"))).alias("_aw"),
        F.sum(S.flag(~at_home & F.col("decided"))).alias("_an"))
    ratings = games.groupBy(F.col("home_team").alias("team")).agg(
        F.avg(elo).alias("_mean"),
        F.max_by(elo, F.struct("game_date", "game_pk")).alias("_latest"))
    out = (ratings.join(sums, "team").join(last_results(games), "team", "left").select(
        "team", F.col("team").alias("team_name"),
        S.half_even("_mean", 1).alias("elo"), S.half_even("_latest", 1).alias("elo_latest"),
        "wins", "losses", S.record_label("wins", "losses").alias("record"),
        S.half_even(F.coalesce(S.ratio("wins", F.col("wins") + F.col("losses")), F.lit(0.0)), 3)
         .alias("pct"),
        F.lit(0).alias("run_diff"),
        S.record_label(F.coalesce("l10_wins", F.lit(0)), F.coalesce("l10_losses", F.lit(0)))
         .alias("l10"),
        S.half_even(F.coalesce(S.ratio("_hw", "_hn"), F.lit(0.0)), 3).alias("home_pct"),
        S.half_even(F.coalesce(S.ratio("_aw", "_an"), F.lit(0.5)), 3).alias("away_pct")))
    return out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("elo"), "team")))
