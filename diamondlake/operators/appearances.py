"""From pitches to one row per (entity, game).

`game_half_pitcher` is the widest aggregate: one pass over the pitches at the grain (game, half
inning side, pitcher). Team batting, team contact, bullpen and starter figures are sums over it,
so the pitch log is shuffled once for all of them, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators.prior import Split, trailing

_GAME = ["game_pk", "game_date", "home_team", "away_team"]
_COUNTED = ["single", "double", "triple", "home_run", "walk", "hit_by_pitch"]


def _event_counts(pa) -> dict:
    out = {f"n_{e}": F.sum(S.flag(F.col("events") == e)) for e in _COUNTED}
    out["n_strikeout"] = F.sum(S.flag(F.col("events").isin(K.STRIKEOUT_EVENTS)))
    out["n_pa"] = F.sum(S.flag(pa))
    return out


# --- game ------------------------------------------------------------------------------------------

def game_results(pitches: DataFrame) -> DataFrame:
    """Score and label at the last pitch, and both starters, in one aggregate per game."""
    order = F.struct("at_bat_number", "pitch_number")
    first_inning = F.col("inning") == 1
    out = (pitches.groupBy("game_pk").agg(
        F.max_by(F.struct("game_date", "home_team", "away_team", "home_score", "away_score"),
                 order).alias("_last"),
        # top of the first: the away side bats, so the home starter pitches
        F.min_by("pitcher", F.when(first_inning & (F.col("inning_topbot") == "Top"), order))
         .alias("home_starter_id"),
        F.min_by("pitcher", F.when(first_inning & (F.col("inning_topbot") == "Bot"), order))
         .alias("away_starter_id"))
        .select("game_pk", "_last.*", "home_starter_id", "away_starter_id"))
    return out.withColumns({
        "home_win": S.winner_label(),
        "total_runs": (F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))),
        "venue": S.venue_of("home_team"),
    })


def team_games(games: DataFrame, *extra: str) -> DataFrame:
    """Two rows per game, one per side; a UNION of both sides without a second scan."""
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team"),
                 F.col("away_team").alias("opponent")),
        F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"),
                 F.col("home_team").alias("opponent")))
    keep = [c for c in ("game_pk", "game_date", *extra)]
    return games.select(*keep, F.inline(sides))


def rest_days(games: DataFrame, split: Split | None = None) -> DataFrame:
    """Days since the previous game of the team; NULL on its first."""
    rows = team_games(games).select("game_pk", "game_date", "team").distinct()
    out = trailing(rows, ["team"], ["game_date", "game_pk"], 1,
                   {"_previous": ("last", "game_date")}, split)
    return out.select("game_pk", "team",
                      F.datediff("game_date", "_previous").alias("rest_days"))


# --- plate appearances -----------------------------------------------------------------------------

def plate_appearances(pitches: DataFrame, split: Split | None = None) -> DataFrame:
    """The last pitch of each plate appearance with runs and outs credited to it.

    Runs are the rise of the total score since the previous plate appearance of the game; the
    first one takes the whole score.
    """
    score = F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))
    last = (pitches.where(S.ends_plate_appearance())
            .groupBy("game_pk", "game_date", "inning", "inning_topbot", "at_bat_number")
            .agg(F.max_by(F.struct(
                "pitcher", "events", "launch_speed", "launch_angle", score.alias("total_score"),
                F.col("estimated_woba_using_speedangle").alias("xwoba")),
                F.col("pitch_number")).alias("_p"))
            .select("game_pk", "game_date", "inning", "inning_topbot", "at_bat_number", "_p.*"))
    seq = trailing(last, ["game_pk"], ["at_bat_number", "inning", "inning_topbot"], 1,
                   {"_before": ("last", "total_score")}, split)
    return seq.select(
        "game_pk", "game_date", "at_bat_number", "inning", "inning_topbot", "pitcher", "events",
        F.when(F.col("_before").isNull(), F.col("total_score"))
         .otherwise(F.greatest(F.col("total_score") - F.col("_before"), F.lit(0)))
         .alias("runs_on_pa"),
        S.outs_on().alias("outs_on_pa"), "xwoba",
        S.barrel().alias("barrel_flag"), S.hard_hit().alias("hard_flag"))


def pitcher_games(pa: DataFrame) -> DataFrame:
    ev = F.col("events")
    return pa.groupBy("game_pk", "game_date", "pitcher").agg(
        F.count(F.lit(1)).alias("n_batters_faced"),
        F.sum("outs_on_pa").alias("outs"),
        F.sum(S.flag(ev.isin(K.STRIKEOUT_EVENTS))).alias("ks"),
        F.sum(S.flag(ev == "walk")).alias("bbs"),
        F.sum(S.flag(ev == "hit_by_pitch")).alias("hbps"),
        F.sum(S.flag(ev.isin(K.HIT_EVENTS))).alias("hits_allowed"),
        F.sum(S.flag(ev == "home_run")).alias("hrs_allowed"),
        F.sum("runs_on_pa").alias("runs"),
        F.avg("xwoba").alias("xwoba"),
        F.avg("barrel_flag").alias("barrel_rate"),
        F.avg("hard_flag").alias("hard_contact_rate"),
    ).withColumn("ip", F.col("outs") / F.lit(3.0))


def pitcher_rates(pg: DataFrame, window: int = 6, split: Split | None = None) -> DataFrame:
    """ERA, K/9, BB/9, WHIP, FIP (without constant) and xwOBA over the previous appearances."""
    sums = ["outs", "runs", "ks", "bbs", "hits_allowed", "hrs_allowed", "hbps"]
    out = trailing(pg, ["pitcher"], ["game_date", "game_pk"], window,
                   {**{f"r_{c}": ("sum", c) for c in sums}, "r_xwoba": ("avg", "xwoba")}, split)
    ip = F.col("r_outs") / F.lit(3.0)
    return out.select(
        "game_pk", "game_date", "pitcher",
        (S.ratio("r_runs", ip) * 9).alias("sp_era"),
        (S.ratio("r_ks", ip) * 9).alias("sp_k9"),
        (S.ratio("r_bbs", ip) * 9).alias("sp_bb9"),
        S.ratio(F.col("r_bbs") + F.col("r_hits_allowed"), ip).alias("sp_whip"),
        S.ratio(13 * F.col("r_hrs_allowed") + 3 * (F.col("r_bbs") + F.col("r_hbps"))
                - 2 * F.col("r_ks"), ip).alias("sp_fip"),
        F.col("r_xwoba").alias("sp_xwoba"))


# --- one pass over the pitches ---------------------------------------------------------------------

def game_half_pitcher(pitches: DataFrame) -> DataFrame:
    """Additive figures per (game, half, pitcher)."""
    pa = S.ends_plate_appearance()
    fast = F.col("pitch_type").isin(K.FASTBALL_TYPES)
    bip = (F.col("description") == "hit_into_play") & F.col("launch_speed").isNotNull()
    xw = F.col("estimated_woba_using_speedangle")
    vs_l, vs_r = pa & (F.col("stand") == "L"), pa & (F.col("stand") == "R")
    sums = {
        **_event_counts(pa),
        "n_pitches": F.count(F.lit(1)),
        "n_outs": F.sum(S.outs_on()),
        "n_lefty": F.sum(S.flag(vs_l)),
        "n_fast": F.sum(S.flag(fast)),
        "s_velo": F.sum(F.when(fast, F.col("release_speed"))),
        "n_velo": F.count(F.when(fast, F.col("release_speed"))),
        "n_whiff": F.sum(S.flag(F.col("description").isin(K.WHIFF_DESCRIPTIONS))),
        "s_xl": F.sum(F.when(vs_l, xw)), "n_xl": F.count(F.when(vs_l, xw)),
        "s_xr": F.sum(F.when(vs_r, xw)), "n_xr": F.count(F.when(vs_r, xw)),
        "n_bip": F.sum(S.flag(bip)),
        "n_barrel": F.sum(F.when(bip, S.barrel(low=26, high=30)).otherwise(0.0)),
        "n_hard": F.sum(F.when(bip, S.hard_hit()).otherwise(0.0)),
        "s_exit": F.sum(F.when(bip, F.col("launch_speed"))),
    }
    return (pitches.groupBy(*_GAME, "inning_topbot", "pitcher")
            .agg(*[c.alias(n) for n, c in sums.items()]))


# --- team batting ----------------------------------------------------------------------------------

_BATTING = [f"n_{e}" for e in _COUNTED] + ["n_strikeout", "n_pa", "n_lefty"]
_CONTACT = ["n_bip", "n_barrel", "n_hard", "s_exit"]


def batting_sums(base: DataFrame, columns=(*_BATTING, *_CONTACT)) -> DataFrame:
    """The base summed per batting team and game, which `team_batting` and `team_contact` can share."""
    return (base.withColumn("team", S.batting_team())
            .groupBy("game_pk", "game_date", "team").agg(*[F.sum(c).alias(c) for c in columns]))


def team_batting(base: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Per batting team and game: counts, wOBA, ISO, K and BB rate, left-handed share.

    `sums` is `batting_sums(base)` where it is at hand.
    """
    sums = batting_sums(base, _BATTING) if sums is None else sums
    g = sums.where(F.col("n_pa") > 0).select("game_pk", "game_date", "team", *_BATTING)
    weighted = S.woba_numerator({e: f"n_{e}" for e in _COUNTED})
    return g.withColumns({
        "woba": S.ratio(weighted, "n_pa"),
        "iso": S.ratio(F.col("n_double") + 2 * F.col("n_triple") + 3 * F.col("n_home_run"),
                       F.col("n_pa") - F.col("n_walk") - F.col("n_hit_by_pitch")),
        "k_rate": S.ratio("n_strikeout", "n_pa"),
        "bb_rate": S.ratio("n_walk", "n_pa"),
        "lefty_share": S.ratio("n_lefty", "n_pa"),
    })


def team_batting_form(batting: DataFrame, window: int = 30, split: Split | None = None) -> DataFrame:
    out = trailing(batting, ["team"], ["game_date", "game_pk"], window, {
        "team_woba_30g": ("avg", "woba"), "team_iso_30g": ("avg", "iso"),
        "team_k_rate_30g": ("avg", "k_rate"), "team_bb_rate_30g": ("avg", "bb_rate"),
        "lineup_lefty_share_30g": ("avg", "lefty_share")}, split)
    return out.select("game_pk", "game_date", "team", "team_woba_30g", "team_iso_30g",
                      "team_k_rate_30g", "team_bb_rate_30g", "lineup_lefty_share_30g")


def team_contact(base: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Per batting team and game over balls in play: barrel rate, hard-hit rate, exit speed.

    `sums` is `batting_sums(base)` where it is at hand.
    """
    sums = batting_sums(base, _CONTACT) if sums is None else sums
    g = sums.where(F.col("n_bip") > 0)
    return g.select("game_pk", "game_date", "team",
                    S.ratio("n_barrel", "n_bip").alias("barrel_rate"),
                    S.ratio("n_hard", "n_bip").alias("hardhit_rate"),
                    S.ratio("s_exit", "n_bip").alias("exitvelo"))


def team_contact_form(contact: DataFrame, window: int = 15, split: Split | None = None) -> DataFrame:
    out = trailing(contact, ["team"], ["game_date", "game_pk"], window, {
        "team_barrel_15g": ("avg", "barrel_rate"), "team_hardhit_15g": ("avg", "hardhit_rate"),
        "team_exitvelo_15g": ("avg", "exitvelo")}, split)
    return out.select("game_pk", "game_date", "team", "team_barrel_15g", "team_hardhit_15g",
                      "team_exitvelo_15g")


# --- bullpen ---------------------------------------------------------------------------------------

def relievers(base: DataFrame, games: DataFrame) -> DataFrame:
    """Rows of the base whose pitcher started for neither side, with their fielding team."""
    starters = games.select("game_pk", "home_starter_id", "away_starter_id")
    not_home = F.col("home_starter_id").isNull() | (F.col("pitcher") != F.col("home_starter_id"))
    not_away = F.col("away_starter_id").isNull() | (F.col("pitcher") != F.col("away_starter_id"))
    return (base.join(starters, "game_pk").where(not_home & not_away)
            .withColumn("team", S.fielding_team()))


def relief_sums(relief: DataFrame) -> DataFrame:
    """Relief rows summed per game and team, which `bullpen_games` and `bullpen_days` can share."""
    hits = sum((F.col(f"n_{e}") for e in K.HIT_EVENTS[1:]), F.col(f"n_{K.HIT_EVENTS[0]}"))
    return (relief.withColumn("_hits", hits)
            .groupBy("game_pk", "game_date", "team").agg(
                F.sum("n_pa").alias("_pa"), F.sum("n_outs").alias("bullpen_outs"),
                F.sum("n_strikeout").alias("bullpen_ks"), F.sum("n_walk").alias("bullpen_bbs"),
                F.sum("_hits").alias("bullpen_hits"),
                F.sum(F.col("_hits") + F.col("n_walk") + F.col("n_hit_by_pitch"))
                 .alias("bullpen_runs"),
                F.sum("n_pitches").alias("_pitches")))


def bullpen_games(relief: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Relief figures per game. The column `bullpen_runs` counts hits, walks and hit batters.

    `sums` is `relief_sums(relief)` where it is at hand.
    """
    sums = relief_sums(relief) if sums is None else sums
    g = sums.where(F.col("_pa") > 0).drop("_pa", "_pitches")
    return g.withColumn("bullpen_ip", F.col("bullpen_outs") / F.lit(3.0))


def bullpen_form(bullpen: DataFrame, window: int = 10, split: Split | None = None) -> DataFrame:
    out = trailing(bullpen, ["team"], ["game_date", "game_pk"], window, {
        "_o": ("sum", "bullpen_outs"), "_b": ("sum", "bullpen_bbs"),
        "_h": ("sum", "bullpen_hits"), "_r": ("sum", "bullpen_runs")}, split)
    ip = F.col("_o") / F.lit(3.0)
    return out.select("game_pk", "game_date", "team",
                      S.ratio(F.col("_b") + F.col("_h"), ip).alias("bullpen_whip_10g"),
                      (S.ratio("_r", ip) * 9).alias("bullpen_era_10g"))


def bullpen_days(relief: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Relief pitches and outs per day and team, from `relief_sums(relief)` where it is at hand."""
    rows = relief if sums is None else sums.withColumnsRenamed(
        {"_pitches": "n_pitches", "bullpen_outs": "n_outs"})
    return (rows.groupBy(F.col("game_date").alias("day"), "team")
            .agg(F.sum("n_pitches").alias("pitches"), F.sum("n_outs").alias("outs")))


# --- starters --------------------------------------------------------------------------------------

def pitcher_stuff(base: DataFrame) -> DataFrame:
    cols = ["n_pitches", "n_fast", "s_velo", "n_velo", "n_whiff", "s_xl", "n_xl", "s_xr", "n_xr"]
    g = base.groupBy("game_pk", "game_date", "pitcher").agg(*[F.sum(c).alias(c) for c in cols])
    return g.select("game_pk", "game_date", "pitcher", "n_pitches",
                    F.col("n_whiff").alias("whiffs"),
                    S.ratio("s_velo", "n_velo").alias("fb_velo"),
                    S.ratio("n_fast", "n_pitches").alias("fb_pct"),
                    S.ratio("s_xl", "n_xl").alias("xwoba_vs_l"),
                    S.ratio("s_xr", "n_xr").alias("xwoba_vs_r"))


def pitcher_stuff_form(stuff: DataFrame, window: int = 3, split: Split | None = None,
                       season: str | None = None) -> DataFrame:
    """Velocity, mix and whiff rate over the previous outings; handed xwOBA over all earlier ones
    (or those of the same season when `season` names a column)."""
    from diamondlake.operators.prior import running

    order = ["game_date", "game_pk"]
    recent = trailing(stuff, ["pitcher"], order, window, {
        "sp_fbvelo_3g": ("avg", "fb_velo"), "sp_fbpct_3g": ("avg", "fb_pct"),
        "_w": ("sum", "whiffs"), "_n": ("sum", "n_pitches")}, split)
    with_counts = recent.withColumns({
        "_has_l": F.col("xwoba_vs_l").isNotNull().cast("int"),
        "_has_r": F.col("xwoba_vs_r").isNotNull().cast("int")})
    keys = ["pitcher"] + ([season] if season else [])
    out = running(with_counts, keys, order,
                  {"_sl": "xwoba_vs_l", "_cl": "_has_l", "_sr": "xwoba_vs_r", "_cr": "_has_r"},
                  None if season else split)
    return out.select("game_pk", "game_date", "pitcher", "sp_fbvelo_3g", "sp_fbpct_3g",
                      S.ratio("_w", "_n").alias("sp_whiff_3g"),
                      S.ratio("_sl", "_cl").alias("sp_xwoba_vs_l"),
                      S.ratio("_sr", "_cr").alias("sp_xwoba_vs_r"))


# --- batters and lineups ---------------------------------------------------------------------------

def batter_games(pitches: DataFrame) -> DataFrame:
    counts = _event_counts(F.lit(True))
    return (pitches.where(S.ends_plate_appearance()).withColumn("team", S.batting_team())
            .groupBy("game_pk", "game_date", "team", "batter")
            .agg(*[c.alias(n) for n, c in counts.items()]))


def batter_form(bg: DataFrame, window: int = 30, split: Split | None = None) -> DataFrame:
    """wOBA numerator, at-bats and plate appearances over the batter's previous games."""
    rows = bg.withColumns({
        "_num": S.woba_numerator({e: f"n_{e}" for e in _COUNTED}),
        "_atb": F.col("n_pa") - F.col("n_walk") - F.col("n_hit_by_pitch")})
    out = trailing(rows, ["batter"], ["game_date", "game_pk", "team"], window, {
        "woba_num": ("sum", "_num"), "ab": ("sum", "_atb"), "pa_30g": ("sum", "n_pa")}, split)
    return out.select("game_pk", "game_date", "team", "batter", "woba_num", "ab", "pa_30g")


def league_mean(form: DataFrame) -> DataFrame:
    """Cumulative league wOBA per date, over the already rolled sums.

    The unpartitioned window runs over one row per date.
    """
    from pyspark.sql import Window

    by_date = form.groupBy("game_date").agg(F.sum("woba_num").alias("_n"), F.sum("ab").alias("_a"))
    w = Window.orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    return by_date.select("game_date", S.ratio(F.sum("_n").over(w), F.sum("_a").over(w))
                          .alias("lg_woba"))


def batter_ratings(form: DataFrame, league: DataFrame, prior_ab: float = K.SHRINKAGE_AB) -> DataFrame:
    """Batter wOBA shrunk toward the league mean; NULL without earlier at-bats."""
    lg = F.coalesce("lg_woba", F.lit(K.LEAGUE_WOBA_DEFAULT))
    return form.join(league, "game_date", "left").select(
        "game_pk", "game_date", "team", "batter", "pa_30g",
        F.when(F.coalesce("ab", F.lit(0)) > 0,
               (F.col("woba_num") + lg * prior_ab) / (F.col("ab") + prior_ab))
         .alias("shrunk_woba"))


def lineups(ratings: DataFrame, size: int = 9, stars: int = 3) -> DataFrame:
    """Mean, star mean and spread over the lineup with the most earlier plate appearances."""
    from pyspark.sql import Window

    w = Window.partitionBy("game_pk", "team").orderBy(F.desc("pa_30g"), "batter")
    top = (ratings.where(F.col("shrunk_woba").isNotNull())
           .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= size))
    return top.groupBy("game_pk", "team").agg(
        F.avg("shrunk_woba").alias("lineup_woba_mean"),
        F.avg(F.when(F.col("_rank") <= stars, F.col("shrunk_woba"))).alias("lineup_woba_top3"),
        F.stddev("shrunk_woba").alias("lineup_woba_std"))
