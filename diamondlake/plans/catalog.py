"""Every operator bound to the test tables, by name. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from types import SimpleNamespace

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import appearances as A
from diamondlake.operators import boosting, drift, folds, metrics, models, ratings
from diamondlake.operators import prior
from diamondlake.plans import bindings as B
from diamondlake.plans import game_features as G
from diamondlake.plans import reports, slate
from diamondlake.session import Stage, tune
from diamondlake.sources import artifacts, cache, landing
from diamondlake.sources import profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT_DAY = "1998-07-01"      # cut between "before" and "after" in the bindings
SLATE_DAY = "2000-06-15"
AFTER_LAST = "2001-08-05"     # a few days after the last game
DRIFT_DAY = "1999-09-09"
CODES = "NYY,BOS,TB,TOR,OAK,CHW,ari ,SEA,MIL,XYZ"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: fn(tune(spark), folder)
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Put doubles on a decimal grid so that the order of summation does not show.

    The grid is cut at 0.31 below the next step: exact halves, which occur in averages, would
    fall on either side of a cut at one half.
    """
    step = float(10 ** digits)
    return df.select(*[
        (F.floor(F.col(c) * step + 0.31) / step).alias(c)
        if isinstance(t.dataType, T.DoubleType) else F.col(c)
        for c, t in zip(df.columns, df.schema.fields)])


def _split(rows: DataFrame, key: str, day: str = "game_date"):
    return prior.hot_split(rows, [key], prior.day_of(day))


def _base(spark, d):
    return A.game_half_pitcher(B.pitches(spark, d))


# --- scans, sources ---------------------------------------------------------------------------------

@query
def scan_date_bounds(spark, d):
    return landing.date_bounds(B.table(spark, d, "orders"), "o_orderdate")


@query
def landed_batch(spark, d):
    df = B.games(spark, d).select("game_pk", "game_date", "home_team")
    return landing.between_dates(df, "1999-12-31", "1997-01-01")


@query
def conform_vendor_rows(spark, d):
    raw = B.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as game_pk", "cast(l_linenumber as string) as at_bat_number",
        "case when l_partkey % 5 = 0 then 'not a date' else cast(date(l_shipdate) as string) end "
        "as game_date", "case when l_suppkey % 3 = 0 then double('NaN') else l_quantity end "
        "as exit_velo", "l_tax as xwoba", "l_returnflag as event", "1 as fielder_2",
        "l_partkey as extra")
    return landing.conform(raw).select(
        "game_pk", "at_bat_number", "game_date", "launch_speed", "events", "extra",
        "estimated_woba_using_speedangle", "zone")


@query
def downcast_numbers(spark, d):
    df = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                              "l_linenumber")
    return landing.downcast(df, ["l_linenumber"])


_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_TIE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus"]


def _line_parts(spark, d):
    lines = B.table(spark, d, "lineitem")
    early = F.coalesce(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("date"), F.lit(False))
    return lines.where(early), lines.where(~early)


@query
def upsert_top_up(spark, d):
    old, new = _line_parts(spark, d)
    return cache.upsert(old, new, True, _LINE_KEY, _LINE_TIE)


@query
def upsert_back_fill(spark, d):
    head, cached = _line_parts(spark, d)
    return cache.upsert(cached, head, False, _LINE_KEY, _LINE_TIE)


@query
def cache_saved(spark, d):
    """Both parts saved one after the other and read back; an order's lines share a partition."""
    old, new = _line_parts(spark, d)
    path, part = Stage(spark).folder + "/cache", F.pmod(F.col("l_orderkey"), F.lit(12))
    cache.save(spark, path, old, part, True, _LINE_KEY, _LINE_TIE)
    return cache.save(spark, path, new, part, True, _LINE_KEY, _LINE_TIE)


@query
def dedupe_first_load(spark, d):
    old, new = _line_parts(spark, d)
    return cache.dedupe(old.unionByName(new), _LINE_KEY, _LINE_TIE, "first")


@query
def missing_days(spark, d):
    return cache.missing_days(B.games(spark, d), "1994-12-01", "2001-12-31")


@query
def scoreboard_games(spark, d):
    def side(name, score):
        return F.struct(
            F.lit(name).alias("homeAway"), score.cast("string").alias("score"),
            F.struct(F.col(f"{name}_team").alias("abbreviation")).alias("team"),
            F.struct(F.when(F.col("game_pk") % 3 == 0, F.concat(
                F.lit("Arm "), F.col(f"{name}_starter_id"))).alias("fullName"))
            .alias("probablePitcher"))

    g = B.games(spark, d)
    shown = F.when(F.col("home_win").isNotNull(), F.col("home_score"))
    shown_away = F.when(F.col("home_win").isNotNull(), F.col("away_score"))
    event = F.struct(
        F.concat(F.date_format("game_date", "yyyy-MM-dd"), F.lit("T23:05Z")).alias("date"),
        F.array(F.struct(F.array(side("away", shown_away), side("home", shown))
                         .alias("competitors"))).alias("competitions"))
    text = g.groupBy("game_date", "league").agg(F.collect_list(event).alias("events")).select(
        F.to_json(F.struct("events")).alias("doc"))
    documents = text.select(F.from_json("doc", landing.SCOREBOARD).alias("j")).select("j.*")
    out = landing.parse_scoreboard(documents)
    return out.select("game_id", "game_date", "start_time_utc", "home_team", "away_team",
                      "home_score", "away_score", "home_win", "total_runs", "sp_name_home",
                      "sp_name_away", "venue")


@query
def schedule_walk_back(spark, d):
    return landing.schedule_on_or_before(B.games(spark, d), AFTER_LAST).select("game_pk", "game_date")


@query
def run_dates(spark, d):
    runs = B.games(spark, d).select(F.date_format("game_date", "yyyyMMdd").alias("run_date"))
    days = B.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("date"))
    return artifacts.run_dates(runs, days)


@query
def pick_run(spark, d):
    return artifacts.pick_run(run_dates(spark, d), "19990230")


@query
def prepared_games(spark, d):
    code = "split_part('" + CODES + "', ',', cast({} % 10 + 1 as int))"
    raw = B.table(spark, d, "orders").selectExpr(
        "o_orderkey as game_pk", "cast(o_orderdate as date) as game_date",
        code.format("o_custkey") + " as home_team", code.format("o_orderkey") + " as away_team",
        "o_totalprice as sp_era_home")
    return landing.prepare_games(raw).select(
        "game_pk", "game_id", "game_date", "start_time_utc", "home_team", "away_team",
        "sp_era_home", "sp_era_30g_home")


# --- point-in-time ----------------------------------------------------------------------------------

@query
def prior_rows(spark, d):
    ev = B.table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return prior.filter_prior(ev, "2024-01-15 12:00:00", "ts")


def _rolling_events(spark, d, split):
    ev = B.table(spark, d, "events").withColumn(
        "observed", F.expr("case when event_type <> 'error' then value end"))
    out = prior.rolling_prior_mean(ev, "user_id", "observed", ["ts", "event_id"], 7, 3,
                                   "mean_7", split)
    return rounded(out.select("event_id", "user_id", "mean_7"))


@query
def rolling_mean(spark, d):
    ev = B.table(spark, d, "events")
    return _rolling_events(spark, d, prior.hot_split(ev, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp"))))


@query
def rolling_mean_hot_keys(spark, d):
    """The same result with every user of more than 60 events cut into ranges of time."""
    ev = B.table(spark, d, "events")
    return _rolling_events(spark, d, prior.hot_split(ev, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 30))


@query
def asof_lines(spark, d):
    return prior.asof_attach(
        B.starts(spark, d), B.quotes(spark, d), "user_id", "start_time", "posted_at",
        ["line", "quote_id"], {"line": K.DEFAULT_JUICE}, "quote_id")


def _daily_events(spark, d):
    return (B.table(spark, d, "events").groupBy("user_id", F.expr(B.EVENT_DAY).alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")))


@query
def trailing_day_load(spark, d):
    return rounded(prior.trailing_days(_daily_events(spark, d), ["user_id"], "day", 3,
                                       {"n_3d": "n", "total_3d": "total"}), 4)


@query
def load_before_events(spark, d):
    ev = B.table(spark, d, "events").where("event_type = 'purchase'").select(
        "event_id", "user_id", F.expr(B.EVENT_DAY).alias("event_day"))
    daily = _daily_events(spark, d)
    return prior.load_before(ev, daily, "user_id", "event_day", "day", 3, {"n_3d": "n"})


@query
def latest_event_values(spark, d):
    ev = B.table(spark, d, "events").selectExpr(
        "user_id", "ts", "event_id", "case when event_type = 'view' then value end as view_value",
        "case when event_type = 'click' then value end as click_value")
    return prior.latest_values(ev, "user_id", ["ts", "event_id"], ["view_value", "click_value"])


# --- appearances ------------------------------------------------------------------------------------

@query
def game_results(spark, d):
    return A.game_results(B.pitches(spark, d))


@query
def rest_days(spark, d):
    g = B.games(spark, d)
    return A.rest_days(g, _split(A.team_games(g), "team"))


@query
def plate_appearances(spark, d):
    p = B.pitches(spark, d)
    return rounded(A.plate_appearances(p, G.pa_split(p)))


def _pitcher_games(spark, d):
    return A.pitcher_games(A.plate_appearances(B.pitches(spark, d)))


@query
def pitcher_games(spark, d):
    return rounded(_pitcher_games(spark, d))


@query
def pitcher_rates(spark, d):
    split = prior.hot_split(B.pitches(spark, d), ["pitcher"], prior.day_of("game_date"))
    return rounded(A.pitcher_rates(_pitcher_games(spark, d), 6, split))


@query
def pitcher_rates_hot_keys(spark, d):
    """The same rates with the windows of busy pitchers cut into ranges of dates."""
    pg = _pitcher_games(spark, d)
    split = prior.hot_split(pg, ["pitcher"], prior.day_of("game_date"), 50)
    return rounded(A.pitcher_rates(pg, 6, split))


@query
def team_batting(spark, d):
    return rounded(A.team_batting(_base(spark, d)))


@query
def team_batting_form(spark, d):
    split = _split(A.team_games(B.games(spark, d)), "team")
    return rounded(A.team_batting_form(A.team_batting(_base(spark, d)), split=split))


@query
def team_contact_form(spark, d):
    split = _split(A.team_games(B.games(spark, d)), "team")
    return rounded(A.team_contact_form(A.team_contact(_base(spark, d)), split=split))


def _relief(spark, d):
    p = B.pitches(spark, d)
    return A.relievers(A.game_half_pitcher(p), A.game_results(p))


@query
def bullpen_games(spark, d):
    return rounded(A.bullpen_games(_relief(spark, d)))


@query
def bullpen_form(spark, d):
    split = _split(A.team_games(B.games(spark, d)), "team")
    return rounded(A.bullpen_form(A.bullpen_games(_relief(spark, d)), split=split))


@query
def bullpen_days(spark, d):
    return A.bullpen_days(_relief(spark, d))


@query
def bullpen_load(spark, d):
    return rounded(G.bullpen_load(B.games(spark, d), A.bullpen_days(_relief(spark, d))))


@query
def pitcher_stuff(spark, d):
    return rounded(A.pitcher_stuff(_base(spark, d)))


@query
def pitcher_stuff_form(spark, d):
    split = prior.hot_split(B.pitches(spark, d), ["pitcher"], prior.day_of("game_date"))
    return rounded(A.pitcher_stuff_form(A.pitcher_stuff(_base(spark, d)), split=split))


@query
def pitcher_stuff_hot_keys(spark, d):
    stuff = A.pitcher_stuff(_base(spark, d))
    split = prior.hot_split(stuff, ["pitcher"], prior.day_of("game_date"), 50)
    return rounded(A.pitcher_stuff_form(stuff, split=split))


@query
def batter_games(spark, d):
    return A.batter_games(B.pitches(spark, d))


def _form(spark, d):
    split = prior.hot_split(B.pitches(spark, d), ["batter"], prior.day_of("game_date"))
    return A.batter_form(A.batter_games(B.pitches(spark, d)), split=split)


@query
def batter_form(spark, d):
    return rounded(_form(spark, d))


@query
def league_mean(spark, d):
    return rounded(A.league_mean(_form(spark, d)))


@query
def batter_ratings(spark, d):
    form = Stage(spark).put("batter_form", _form(spark, d))
    return rounded(A.batter_ratings(form, A.league_mean(form)))


@query
def lineups(spark, d):
    form = Stage(spark).put("batter_form", _form(spark, d))
    return rounded(A.lineups(A.batter_ratings(form, A.league_mean(form))))


@query
def game_features(spark, d):
    stage = Stage(spark)
    p = stage.put("pitches", B.pitches(spark, d).select(*G.GAME_INPUT))
    return rounded(G.build_game_features(p, stage), 5)


@query
def pitch_features(spark, d):
    stage = Stage(spark)
    p = stage.put("pitches", B.pitches(spark, d).select(*G.GAME_INPUT, *G.SITUATION_INPUT))
    out = G.build_pitch_features(p, G.build_game_features(p, stage))
    return rounded(out.select(
        *K.PITCH_KEY, "bases_loaded", "runners_in_scoring_position", "is_risp", "score_diff",
        "batting_team", "ab_pitch_count", "times_through_order", "lr_matchup", "exit_velocity",
        "launch_angle_f", "pitch_category", *G.PITCH_ROW_FEATURES), 5)


# --- ratings and records ----------------------------------------------------------------------------

@query
def elo_entering(spark, d):
    return rounded(ratings.elo_entering(B.games(spark, d), "league"), 4)


@query
def elo_as_of(spark, d):
    g = B.games(spark, d).withColumn("start_time_utc", S.default_start("game_date"))
    return rounded(ratings.elo_as_of(g, "2000-06-15 00:00:00", league="league")
                   .drop("season"), 4)


@query
def elo_by_season(spark, d):
    """The same ratings with a season of a league as the largest task."""
    return rounded(ratings.elo_by_season(B.games(spark, d), Stage(spark), "league"), 4)


@query
def elo_resumed(spark, d):
    """Ratings of the later games from the rating table at the cut."""
    g = B.games(spark, d).withColumn("start_time_utc", S.default_start("game_date"))
    cut = f"{SPLIT_DAY} 00:00:00"
    state = ratings.elo_as_of(g, cut, league="league")
    later = g.where(F.col("start_time_utc") >= F.lit(cut).cast("timestamp_ntz"))
    return rounded(ratings.elo_entering(later, "league", state), 4)


@query
def records_entering(spark, d):
    g = B.games(spark, d)
    return ratings.records_entering(g, _split(A.team_games(g, "season"), "team"))


@query
def records_entering_hot_keys(spark, d):
    """The same records with team-seasons of more than 100 games cut into ranges of dates."""
    g = B.games(spark, d)
    split = prior.hot_split(A.team_games(g, "season"), ["team", "season"],
                            prior.day_of("game_date"), 100)
    return ratings.records_entering(g, split)


@query
def final_records(spark, d):
    return ratings.final_records(B.games(spark, d))


@query
def last_played(spark, d):
    return ratings.last_played(B.games(spark, d))


@query
def last_ten(spark, d):
    return ratings.last_results(B.games(spark, d))


def _rated(spark, d):
    return B.games(spark, d).withColumn("home_elo", F.expr(
        "cast(1400 as double) + cast(floor(o_totalprice / 1000) as bigint) % 200"))


@query
def power_rankings(spark, d):
    return ratings.power_rankings(_rated(spark, d))


@query
def top_teams(spark, d):
    return (artifacts.top_by(power_rankings(spark, d), "elo", 15, tie_break="team")
            .select("rank", "team", "elo", "record"))


# --- slate ------------------------------------------------------------------------------------------

def _all_history(spark, d):
    """Games with two side features and starters."""
    return B.games(spark, d).selectExpr(
        "*", "case when game_pk % 3 = 0 then o_totalprice end as woba_30g_home",
        "case when game_pk % 4 = 0 then o_totalprice / 2 end as woba_30g_away",
        "case when game_pk % 5 = 0 then o_totalprice / 4 end as sp_era_home",
        "case when game_pk % 2 = 0 then o_totalprice / 8 end as sp_era_away",
        "case when game_pk % 7 = 0 then prob end as opp_lefty_share_home",
        "case when game_pk % 6 = 0 then prob / 2 end as opp_lefty_share_away")


def _history(spark, d):
    """The games before the slate day."""
    return _all_history(spark, d).where(F.col("game_date") < F.lit(SLATE_DAY).cast("date"))


@query
def team_state(spark, d):
    return slate.team_state(_history(spark, d))


@query
def pitcher_state(spark, d):
    return slate.pitcher_state(_history(spark, d))


@query
def own_lefty_share(spark, d):
    return slate.own_lefty_share(_history(spark, d))


@query
def name_crosswalk(spark, d):
    return slate.name_crosswalk(B.pitches(spark, d))


@query
def upcoming_slate(spark, d):
    g = B.games(spark, d)
    schedule = (landing.schedule_on(g, SLATE_DAY)
                .withColumn("start_time_utc", S.default_start("game_date"))
                .withColumn("sp_name_home", F.concat(F.lit("First  Last"), "home_starter_id"))
                .withColumn("sp_name_away", F.concat(F.lit("First Last"), "away_starter_id"))
                .drop("home_win", "home_score", "away_score"))
    # the history goes on past the day, the slate must not see it
    out = slate.build_upcoming_slate(_all_history(spark, d), SLATE_DAY, schedule,
                                     slate.name_crosswalk(B.pitches(spark, d)))
    return rounded(out.select(
        "game_id", "game_date", "start_time_utc", "home_team", "away_team", "home_record",
        "away_record", "home_win_pct", "away_win_pct", "home_run_diff", "away_run_diff",
        "rest_days_home", "rest_days_away", "woba_30g_home", "woba_30g_away",
        "opp_lefty_share_home", "opp_lefty_share_away", "sp_era_home", "sp_era_away", "home_win"))


# --- metrics ----------------------------------------------------------------------------------------

@query
def pooled_metrics(spark, d):
    return rounded(metrics.binary_metrics(B.scored(spark, d), p="prob", digits=None))


@query
def season_metrics(spark, d):
    return rounded(metrics.binary_metrics(B.scored(spark, d), p="prob", by=["season"], digits=None))


@query
def auc_by_league(spark, d):
    return rounded(metrics.auc(B.scored(spark, d), "home_win", "prob", ["league"]))


@query
def calibration_buckets(spark, d):
    return rounded(metrics.calibration_buckets(B.scored(spark, d), p="prob", digits=None))


@query
def reliability_total(spark, d):
    return rounded(metrics.reliability_with_total(
        metrics.calibration_buckets(B.scored(spark, d), p="prob", digits=None)))


@query
def daily_calibration(spark, d):
    out = metrics.daily_calibration(B.games(spark, d), p="prob", digits=None)
    return rounded(out.select("date", "n_games", "home_wins", "home_losses", "picks_correct",
                      "metrics.*", F.explode("buckets").alias("b")).select(
        "*", "b.bucket", "b.mean_predicted", "b.mean_actual", "b.gap",
        F.col("b.count").alias("bucket_count")).drop("b"))


@query
def rolling_brier(spark, d):
    return rounded(metrics.rolling_brier(B.scored(spark, d), p="prob"))


@query
def prediction_history(spark, d):
    g = B.games(spark, d).withColumn("game_id", S.game_id("game_date", "away_team", "home_team"))
    return metrics.newest_first(metrics.prediction_history(g, "prob"))


@query
def display_games(spark, d):
    code = "split_part('" + CODES + "', ',', cast({} % 10 + 1 as int))"
    g = B.games(spark, d).selectExpr(
        "game_pk", "home_win", "prob as home_win_prob_model",
        code.format("game_pk") + " as home_team", code.format("(game_pk + 3)") + " as away_team",
        "cast(game_date as timestamp_ntz) + interval 14 hours "
        "+ make_interval(0, 0, 0, 0, cast(game_pk % 14 as int)) as start_time_utc")
    now = F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")
    out = metrics.display_columns(g, now)
    return out.select("game_pk", "game_status", "evening_game", "day_game", "home_team_name",
                      "away_team_name", "model_pick", "model_correct", "is_upset", "is_coin_flip")


@query
def status_summary(spark, d):
    g = B.games(spark, d).withColumns({
        "home_win_prob_model": F.col("prob"), "start_time_utc": S.default_start("game_date")})
    shown = metrics.display_columns(g, F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"))
    a = metrics.status_counts(shown).withColumn("k", F.lit(1))
    b = metrics.day_record(shown).withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k")


@query
def upset_list(spark, d):
    g = B.games(spark, d).withColumns({
        "home_win_prob_model": F.col("prob"), "start_time_utc": S.default_start("game_date")})
    shown = metrics.display_columns(g, F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"))
    return rounded(metrics.upsets(shown))


@query
def filled_scores(spark, d):
    g = B.games(spark, d)
    known = g.select("game_pk", F.expr("case when game_pk % 2 = 0 then home_score end")
                     .alias("home_score"), F.lit(None).cast("int").alias("away_score"))
    return metrics.fill_scores(known, g, "game_pk")


@query
def market_edges(spark, d):
    g = B.games(spark, d).selectExpr(
        "game_pk", "prob as home_win_prob_model",
        "case when game_pk % 5 > 0 then cast(100 + game_pk % 90 as int) * "
        "case when game_pk % 2 = 0 then -1 else 1 end end as moneyline_home",
        "case when game_pk % 7 > 0 then cast(-110 - game_pk % 60 as int) end as moneyline_away")
    return metrics.edges_against_market(g)


@query
def american_lines(spark, d):
    g = B.games(spark, d)
    line = S.probability_to_american("prob")
    return rounded(g.select("game_pk", line.alias("line"),
                            S.american_to_probability(line).alias("back")))


@query
def range_accuracy(spark, d):
    history = metrics.prediction_history(B.games(spark, d), "prob")
    return reports.accuracy(landing.between_dates(history, "1996-01-01", "1999-12-31"))


@query
def local_times(spark, d):
    ev = B.table(spark, d, "events")
    eastern = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return ev.select("event_id", eastern.alias("eastern"), S.is_evening("ts").alias("evening"),
                     S.utc_naive(eastern, "America/New_York").alias("back"))


@query
def event_properties(spark, d):
    props = F.from_json("props", "k bigint, note string")
    return B.table(spark, d, "events").select(
        "event_id", F.coalesce(props["k"], F.lit(0)).alias("k"),
        F.coalesce(props["note"], F.lit("none")).alias("note"))


# --- folds ------------------------------------------------------------------------------------------

@query
def fold_table(spark, d):
    return folds.fold_table(B.games(spark, d), min_train_days=30)


@query
def recent_folds(spark, d):
    return folds.fold_table(B.games(spark, d), cadence=10, max_folds=25)


@query
def fold_of_game(spark, d):
    g = B.games(spark, d)
    return folds.with_fold(g, folds.fold_dates(g)).select("game_pk", "fold_idx")


# --- drift ------------------------------------------------------------------------------------------

def _windows(spark, d):
    """The drift windows of all games, with five measures."""
    games = B.games(spark, d).withColumn("starter", F.expr(
        "case when game_pk % 4 > 0 then cast(home_starter_id as double) end"))
    return drift.drift_windows(games, DRIFT_DAY)


_MEASURES = ["o_totalprice", "prob", "home_score", "away_score", "starter"]


@query
def quantiles(spark, d):
    df = B.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    out = drift.exact_quantiles(drift.long_form(df, df.columns), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
    return rounded(out.select("feature", "n", *[
        F.col("quantiles")[i].alias(f"q{i}") for i in range(6)]))


@query
def column_medians(spark, d):
    df = B.table(spark, d, "lineitem").selectExpr(
        "l_quantity", "case when l_partkey % 3 = 0 then l_extendedprice end as some",
        "cast(null as double) as none")
    return rounded(drift.medians(df, ["l_quantity", "some", "none"]))


@query
def population_stability(spark, d):
    base, cur = _windows(spark, d)
    values = (drift.long_form(base.withColumn("is_current", F.lit(False)), _MEASURES, "is_current")
              .unionByName(drift.long_form(cur.withColumn("is_current", F.lit(True)), _MEASURES,
                                           "is_current")))
    return drift.psi(values)


@query
def feature_drift(spark, d):
    base, cur = _windows(spark, d)
    return drift.feature_drift(base, cur, _MEASURES)


@query
def drift_baseline(spark, d):
    base, cur = drift.drift_windows(B.games(spark, d), DRIFT_DAY)
    return (base.select("game_pk", F.lit("baseline").alias("part"))
            .unionByName(cur.select("game_pk", F.lit("current").alias("part"))))


@query
def drift_baseline_of_names(spark, d):
    """The baseline where the id is text, ranked in the order of the text."""
    named = B.games(spark, d).withColumn("game_pk", F.concat(F.lit("g"), "game_pk"))
    base, _ = drift.drift_windows(named, DRIFT_DAY)
    return base.select("game_pk")


@query
def drift_flags(spark, d):
    out = drift.drift_summary(feature_drift(spark, d))
    return out.select("warnings", "alerts", F.array_join("features", ",").alias("features"))


@query
def feature_coverage(spark, d):
    return drift.feature_coverage(_history(spark, d), [
        "woba_30g_home", "sp_era_home", "opp_lefty_share_home", "home_win", "absent"])


# --- models (no SQL form) ---------------------------------------------------------------------------

# Published settings, every model feature the frame has and every fold. A boosted member of 300 rounds is several hundred small jobs.

def _model_games(spark, d):
    return Stage(spark).put("model_games", G.enrich_games(B.games(spark, d)).withColumns({
        "game_id": S.game_id("game_date", "away_team", "home_team"),
        "total_runs": F.col("home_score") + F.col("away_score")}))


def _features(g):
    return [c for c in K.FEATURES if c in g.columns]


def _every_fold(spark, d):
    g = _model_games(spark, d)
    return models.walk_forward(g, _features(g), cadence=K.RETRAIN_CADENCE)


@query
def walk_forward_predictions(spark, d):
    return _every_fold(spark, d).select("game_pk", "fold_idx", "home_win", "p_boosted_a", "p_boosted_b",
                                        "p_logistic", "home_win_prob_model")


@query
def member_roster(spark, d):
    return models.roster(_every_fold(spark, d), list(K.MEMBER_WEIGHTS))


@query
def linear_attributions(spark, d):
    g = _model_games(spark, d)
    ens = models.fit(g, _features(g), models.Settings(members=("logistic",)))
    return models.attributions(ens, g, "game_pk")


@query
def totals_predictions(spark, d):
    g = _model_games(spark, d)
    out, _ = models.totals_head(g.where("season < 2000"), g.where("season >= 2000"), _features(g))
    return out.select("game_pk", "total_runs", "total_runs_model")


@query
def run_line_predictions(spark, d):
    g = _model_games(spark, d)
    out, _ = models.run_line_head(g.where("season < 2000"), g.where("season >= 2000"), _features(g))
    return out.select("game_pk", F.col("home_win_prob_model").alias("cover_prob"))


# --- reports ----------------------------------------------------------------------------------------

@query
def calibration_view(spark, d):
    """The calibration document written as JSON text and read back for one day."""
    oof = B.scored(spark, d).withColumn("home_win_prob_model", F.col("prob"))
    text = reports.calibration_record(oof, "20000615", digits=None).select(
        F.to_json(F.struct("*")).alias("doc"))
    documents = text.select(F.from_json("doc", artifacts.CALIBRATION).alias("j")).select("j.*")
    view = artifacts.calibration_view(documents, "20000615")
    return rounded(
        view.select("date", "kpis.*", "day_record.*", F.explode("confidence").alias("c")).select(
            "date", "auc_roc", "brier_score", "log_loss", "cal_error", "wins", "losses",
            "completed", "c.bucket", F.col("c.count").alias("bucket_count"), "c.accuracy_pct"))


@query
def monitor_record(spark, d):
    oof = B.scored(spark, d).withColumn("home_win_prob_model", F.col("prob"))
    base, cur = _windows(spark, d)
    out = reports.monitor_record(
        rounded(metrics.binary_metrics(oof, digits=None)), drift.feature_drift(base, cur, _MEASURES),
        metrics.rolling_brier(oof), "20000615", "v1", "2000-06-15")
    return out.select("date", "version", "last_retrained", "next_retrain", "metrics.auc",
                      "metrics.brier", "drift_summary.warnings", "drift_summary.alerts",
                      F.size("feature_drift").alias("n_features"),
                      F.size("rolling_brier").alias("n_days"))


# --- parts of the models that SQL can state ---------------------------------------------------------

_INPUTS = ["o_totalprice", "home_starter", "nothing"]


def _inputs(spark, d):
    return B.games(spark, d).withColumns({
        "home_starter": F.expr("case when game_pk % 3 > 0 then cast(home_starter_id as double) end"),
        "nothing": F.lit(None).cast("double")})


@query
def standardised_inputs(spark, d):
    g = _inputs(spark, d)
    ens = models.input_stats(g, _INPUTS)
    linear = models.vectors(g, ens).select("game_pk", vector_to_array("_linear").alias("z"),
                                           vector_to_array("_tree").alias("t"))
    return rounded(linear.select("game_pk", *[F.col("z")[i].alias(f"z_{c}") for i, c in enumerate(_INPUTS)],
                                 F.col("t")[1].alias("tree_value"), F.col("t")[4].alias("tree_missing")), 4)


def _members(spark, d):
    """Decided games with stand-in columns of the three members."""
    return B.scored(spark, d).withColumns({
        "p_boosted_a": F.col("prob"), "p_boosted_b": F.expr("cast(game_pk % 101 as double) / 100"),
        "p_logistic": F.expr("cast(game_pk * 7 % 1000 as double) / 1000")})


@query
def blended_members(spark, d):
    m = _members(spark, d)
    three = models.blended(m, models.member_weights(list(K.MEMBER_WEIGHTS)))
    two = models.blended(m, models.member_weights(["boosted_a", "logistic"]))
    return rounded(three.select("game_pk", F.col("home_win_prob_model").alias("p")).join(
        two.select("game_pk", F.col("home_win_prob_model").alias("p_of_two")), "game_pk"))


@query
def roster_of_columns(spark, d):
    return rounded(models.roster(_members(spark, d), ["boosted_a", "logistic"]), 4)


@query
def picked_games(spark, d):
    g = _members(spark, d).selectExpr(
        "game_pk", "home_team", "away_team", "p_boosted_b as home_win_prob_model",
        "case when game_pk % 5 > 0 then cast(100 + game_pk % 90 as int) end as moneyline_home",
        "case when game_pk % 7 > 0 then cast(-110 - game_pk % 60 as int) end as moneyline_away")
    return models.with_picks(g).drop("moneyline_home", "moneyline_away")


@query
def cover_labels(spark, d):
    return B.games(spark, d).select("game_pk", models.cover_label().alias("cover"),
                                    models.cover_label(as_home_win=True).alias("win"))


@query
def total_errors(spark, d):
    g = B.games(spark, d).withColumns({"total": F.col("home_score") + F.col("away_score"),
                                       "guess": F.col("prob") * 10})
    return metrics.regression_errors(g, "total", "guess")


@query
def given_attributions(spark, d):
    """The shares of a linear member whose coefficients are given."""
    ens = models.Ensemble(["o_totalprice", "prob"], {"o_totalprice": 0.0, "prob": 0.5},
                          {"o_totalprice": 1000.0, "prob": 0.5}, {"o_totalprice": 500.0, "prob": 0.25},
                          {"logistic": SimpleNamespace(coefficients=Vectors.dense([0.01, -2.0]))})
    return models.attributions(ens, B.games(spark, d), "game_pk")


# one round of two levels of each boosted head, on every row and with missing values
_ROUND = boosting.Growth(rounds=1, depth=2, subsample=1.0)
_TREE_INPUTS = ["o_totalprice", "home_starter", "prob"]


def _tree_inputs(spark, d):
    return _inputs(spark, d).withColumns({"total_runs": F.col("home_score") + F.col("away_score"),
                                          "cover": models.cover_label()})


@query
def boosted_tree(spark, d):
    """The nodes of the first tree of the win head: splits with their place for missing values, and values."""
    forest = boosting.boost(_tree_inputs(spark, d), _TREE_INPUTS, "home_win", _ROUND)
    nodes = [(k, n.feature, n.cut, n.missing_left if n.feature else None, n.gain if n.feature else None, n.value)
             for tree in forest.trees for k, n in tree.items()]
    return rounded(spark.createDataFrame(
        nodes, "node int, feature string, cut double, missing_left boolean, gain double, value double"))


@query
def totals_round(spark, d):
    """Run totals by the mean and one tree under squared loss."""
    g = _tree_inputs(spark, d)
    forest = boosting.boost(g, _TREE_INPUTS, "total_runs", replace(_ROUND, loss="squared"))
    return rounded(g.select("game_pk", "total_runs", forest.prediction().alias("predicted")))


@query
def run_line_round(spark, d):
    """Cover probabilities by one tree."""
    g = _tree_inputs(spark, d)
    forest = boosting.boost(g, _TREE_INPUTS, "cover", _ROUND)
    return rounded(g.select("game_pk", "cover", forest.prediction().alias("predicted")))


@query
def forest_attributions(spark, d):
    """Path-wise shares of a given forest of two trees, one with a place for missing values."""
    leaf = boosting.Node
    forest = boosting.Forest(0.1, [
        {1: leaf(0.02, "o_totalprice", 150000.0), 2: leaf(-0.3, "home_starter", 40.0, missing_left=True),
         3: leaf(0.4), 4: leaf(-0.5), 5: leaf(0.125)},
        {1: leaf(-0.01, "home_starter", None), 2: leaf(0.05, "o_totalprice", 90000.0), 3: leaf(-0.2),
         4: leaf(0.25), 5: leaf(-0.07)}])
    return boosting.tree_attributions(forest, _tree_inputs(spark, d), _TREE_INPUTS, "game_pk")


# --- round trips ------------------------------------------------------------------------------------

@query
def games_read_back(spark, d):
    """Games written as CSV and as Parquet and read by the game reader."""
    folder = Stage(spark).folder
    g = B.games(spark, d).select("game_pk", "game_date", "home_team", "prob", "home_win")
    g.write.option("header", True).csv(f"{folder}/games.csv")
    artifacts.write_parquet(g, f"{folder}/games", ["home_team"])
    schema = "game_pk bigint, game_date date, home_team string, prob double, home_win int"
    text = landing.read_games(spark, f"{folder}/games.csv", schema)
    return text.unionByName(landing.read_games(spark, f"{folder}/games").select(*text.columns))


@query
def landed_days(spark, d):
    """Pitches of a range of dates from landed files."""
    path = f"{Stage(spark).folder}/landed"
    artifacts.write_sorted(B.pitches(spark, d), path, ["game_date", "game_pk"])
    return landing.read_landed(spark, path, "1996-02-01", "1999-10-31").select(*K.PITCH_KEY, "game_date", "events")


@query
def attributions_read_back(spark, d):
    """Attributions written as one partition per season and run, read back for one run."""
    path = f"{Stage(spark).folder}/attributions"
    rows = given_attributions(spark, d).join(B.games(spark, d).select("game_pk", "season"), "game_pk")
    for run in ("20000614", "20000615"):
        artifacts.write_csv(rows, path, run, ["season"])
    schema = "game_pk bigint, feature string, attribution double, signed_effect string, rank int"
    return artifacts.read_run(spark, path, "20000615", schema).drop("run_date", "season")


@query
def history_read_back(spark, d):
    """One row a season appended to the history table twice."""
    path = f"{Stage(spark).folder}/history"
    for version in ("v1", "v2"):
        artifacts.append_history(season_metrics(spark, d).withColumn("version", F.lit(version)), path)
    return spark.read.parquet(path)


@query
def known_venues(spark, d):
    code = "split_part('" + CODES + "', ',', cast(game_pk % 10 + 1 as int))"
    return B.games(spark, d).selectExpr("game_pk", code + " as team").select(
        "game_pk", "team", S.venue_of(S.canonical_team("team")).alias("venue"))


@query
def present_columns(spark, d):
    """The columns of a list that the games have, in the order of the list."""
    return landing.existing(B.games(spark, d), ["prob", "absent", "game_pk", "home_team", "prob", "moneyline_home"])


@query
def newest_games(spark, d):
    """The fallback slate: the last fifteen games in order of date and id."""
    return artifacts.latest_rows(B.games(spark, d), ["game_date", "game_pk"], 15).select("game_pk", "game_date", "home_team")


@query
def calibration_read_back(spark, d):
    """The calibration documents of two runs written as JSON, one read back by its schema."""
    path = f"{Stage(spark).folder}/calibration"
    oof = B.scored(spark, d).withColumn("home_win_prob_model", F.col("prob"))
    for run in ("20000614", "20000615"):
        artifacts.write_json(reports.calibration_record(oof, run, digits=None), path, run)
    documents = spark.read.schema(artifacts.CALIBRATION).json(f"{path}/run_date=20000615")
    view = artifacts.calibration_view(documents, "20000615")
    return rounded(view.select("date", "kpis.*", "day_record.*", F.explode("confidence").alias("c")).select(
        "date", "auc_roc", "brier_score", "log_loss", "cal_error", "wins", "losses", "completed", "c.bucket",
        F.col("c.count").alias("bucket_count"), "c.accuracy_pct"))


@query
def bundle_read_back(spark, d):
    """Win probabilities by a saved and reloaded bundle: its boosted member, and its metadata."""
    g = _tree_inputs(spark, d)
    ens = models.input_stats(g.where("home_win is not null"), _TREE_INPUTS)
    ens.models["boosted_b"] = boosting.boost(g, _TREE_INPUTS, "home_win", _ROUND)
    path = f"{Stage(spark).folder}/bundle"
    models.save(ens, {"auc": 0.5}, path, spark, "v7", datetime(2000, 6, 15), "2000-06-14")
    again = models.load(path, spark)
    return rounded(models.member_probabilities(again, g).select(
        "game_pk", F.lit(again.metadata["version"]).alias("version"),
        F.lit(again.metadata["data_cutoff"]).alias("data_cutoff"), F.col("home_win_prob_model").alias("p")))


@query
def column_types(spark, d):
    """The type that the range, the missing values and the number of values of each line item column choose."""
    return profile.chosen(B.table(spark, d, "lineitem")).select(
        "position", "column", "n_rows", "n_null", "least", "greatest", "nullable", "chosen")


@query
def category_codes(spark, d):
    """Code and value of the string columns of line items and events that become categories."""
    found = []
    for name in ("lineitem", "events"):
        df = B.table(spark, d, name)
        coded = [r["column"] for r in profile.chosen(df).filter("chosen = 'category'").collect()]
        found.append(profile.dictionary(df, coded))
    return found[0].union(found[1])
