"""DuckDB statements that give the same rows as the registered queries, written independently.

They start from the same bound rows (`diamondlake.plans.bindings`) and shift first, then roll,
where the Spark side uses a single frame over earlier rows.
"""

from __future__ import annotations

from diamondlake import constants as K
from diamondlake.plans.bindings import games_sql, pitches_sql
from diamondlake.plans.catalog import AFTER_LAST, CODES, SLATE_DAY, SPLIT_DAY
from diamondlake.plans.game_features import PITCH_ROW_FEATURES

PA = ", ".join(f"'{e}'" for e in K.PA_END_EVENTS)
HITS = "'single', 'double', 'triple', 'home_run'"
STRIKEOUTS = "'strikeout', 'strikeout_double_play'"
OUTS = "case events " + " ".join(
    f"when '{e}' then {n}" for e, n in K.OUTS_ON_EVENT.items()) + " else 0 end"
VENUE = "case home_team " + " ".join(
    "when '{}' then '{}'".format(t, v) for t, v in K.VENUES.items()) + " else 'Unknown' end"
BAT = "case when inning_topbot = 'Top' then away_team else home_team end"
FIELD = "case when inning_topbot = 'Top' then home_team else away_team end"


def n(cond: str) -> str:
    return f"cast(sum(case when {cond} then 1 else 0 end) as bigint)"


def s(expr: str) -> str:
    return f"cast(sum({expr}) as bigint)"


def d(num: str, den: str) -> str:
    return f"cast({num} as double) / nullif(cast({den} as double), 0)"


def r(expr: str, digits: int = 6) -> str:
    """Same grid as `catalog.rounded`."""
    return f"floor(({expr}) * 1e{digits} + 0.31e0) / 1e{digits}"


def even(expr: str, digits: int) -> str:
    return f"round_even(cast({expr} as double), {digits})"


def shifted(values: list[str], keys: str, order: str) -> str:
    """LAG columns `p_x` for each x."""
    return ", ".join(f"lag({v}) over (partition by {keys} order by {order}) as p_{v}"
                     for v in values)


def frame(keys: str, order: str, rows: int) -> str:
    return (f"(partition by {keys} order by {order} "
            f"rows between {rows - 1} preceding and current row)")


GAMES = f"games as ({games_sql()})"
PITCHES = f"pitches as ({pitches_sql()})"
SIDES = """sides as (
  select *, 'home' as side, home_team as team, away_team as opponent from games
  union all
  select *, 'away' as side, away_team as team, home_team as opponent from games)"""

O: dict[str, str] = {}

# --- sources ----------------------------------------------------------------------------------------

O["scan_date_bounds"] = "select min(o_orderdate) as earliest, max(o_orderdate) as latest from orders"
O["landed_batch"] = f"""with {GAMES} select game_pk, game_date, home_team from games
where game_date >= date '1997-01-01' and game_date <= date '1999-12-31'"""
O["conform_vendor_rows"] = """select l_orderkey as game_pk, l_linenumber as at_bat_number,
 case when l_partkey % 5 <> 0 then cast(l_shipdate as date) end as game_date,
 case when l_suppkey % 3 <> 0 then l_quantity end as launch_speed, l_returnflag as events,
 l_partkey as extra, l_tax as estimated_woba_using_speedangle, cast(null as double) as zone
from lineitem"""
O["downcast_numbers"] = """select l_orderkey, l_partkey, cast(l_quantity as float) as l_quantity,
 cast(l_linenumber as smallint) as l_linenumber from lineitem"""

_TIE = "l_shipdate {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}, l_extendedprice {0}, " \
       "l_discount {0}, l_tax {0}, l_returnflag {0}, l_linestatus {0}"
_LINE_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, " \
             "l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def _line_pick(first: str, direction: str) -> str:
    return f"""select {_LINE_COLS} from (select *, row_number() over (
 partition by l_orderkey, l_linenumber order by {first}{_TIE.format(direction)}) as rn
 from lineitem) where rn = 1"""


_NEWER = f"coalesce(l_shipdate >= date '{SPLIT_DAY}', true)"
O["upsert_top_up"] = _line_pick(f"{_NEWER} desc, ", "desc")
# the back-filled rows are those before the cut; cached rows, those after it, win as well
O["upsert_back_fill"] = _line_pick(f"{_NEWER} desc, ", "desc")
O["cache_saved"] = O["upsert_top_up"]
O["dedupe_first_load"] = _line_pick("", "asc")
O["missing_days"] = """select cast(day as date) as day from
 (select unnest(generate_series(date '1994-12-01', date '2001-12-31', interval 1 day)) as day)
where cast(day as date) not in (select cast(o_orderdate as date) from orders)"""
O["scoreboard_games"] = f"""with {GAMES} select
 strftime(game_date, '%Y%m%d') || '_' || away_team || '@' || home_team as game_id, game_date,
 cast(game_date as timestamp) + interval '23 hours 5 minutes' as start_time_utc,
 home_team, away_team,
 case when home_win is not null then home_score end as home_score,
 case when home_win is not null then away_score end as away_score,
 cast(home_win as double) as home_win,
 case when home_win is not null then home_score + away_score end as total_runs,
 case when game_pk % 3 = 0 then 'Arm ' || home_starter_id else 'TBD' end as sp_name_home,
 case when game_pk % 3 = 0 then 'Arm ' || away_starter_id else 'TBD' end as sp_name_away,
 'Unknown' as venue from games"""
O["schedule_walk_back"] = f"""with {GAMES}, w as (select * from games
 where game_date between date '{AFTER_LAST}' - 7 and date '{AFTER_LAST}')
select game_pk, game_date from w where game_date = (select max(game_date) from w)"""
O["run_dates"] = """select distinct run_date from (
 select strftime(o_orderdate, '%Y%m%d') as run_date from orders
 union all select strftime(ts, '%Y%m%d') from events)"""
O["pick_run"] = f"""select coalesce(max(case when run_date = '19990230' then run_date end),
 max(run_date)) as run_date from ({O["run_dates"]})"""


def _canonical(code: str) -> str:
    code = f"trim({code})"
    return (f"case upper({code}) when 'CHW' then 'CWS' when 'CHA' then 'CWS' "
            f"when 'OAK' then 'ATH' when 'ARI' then 'AZ' else {code} end")


def _code(expr: str) -> str:
    return f"split_part('{CODES}', ',', cast({expr} % 10 + 1 as int))"


O["prepared_games"] = f"""with g as (select o_orderkey as game_pk,
 cast(o_orderdate as date) as game_date, {_canonical(_code("o_custkey"))} as home_team,
 {_canonical(_code("o_orderkey"))} as away_team, o_totalprice as sp_era_home from orders)
select game_pk, strftime(game_date, '%Y%m%d') || '_' || away_team || '@' || home_team as game_id,
 game_date, cast(game_date as timestamp) + interval 19 hours as start_time_utc, home_team,
 away_team, sp_era_home, sp_era_home as sp_era_30g_home from g"""

# --- point-in-time ----------------------------------------------------------------------------------

O["prior_rows"] = """select event_id, ts, user_id, value from events
where ts < timestamp '2024-01-15 12:00:00'"""
O["rolling_mean"] = f"""with e as (select *,
 case when event_type <> 'error' then value end as observed from events),
l as (select *, lag(observed) over (partition by user_id order by ts, event_id) as p from e)
select event_id, user_id, {r("case when count(p) over w >= 3 then avg(p) over w end")} as mean_7
from l window w as {frame("user_id", "ts, event_id", 7)}"""
O["rolling_mean_hot_keys"] = O["rolling_mean"]
O["asof_lines"] = """with q as (select user_id, ts as posted_at, value as line, event_id as quote_id
 from events where event_type = 'view'),
s as (select event_id, user_id, ts as start_time from events where event_type = 'purchase')
select s.event_id, s.user_id, s.start_time,
 case when q.quote_id is null then 0.04 else q.line end as line, q.quote_id
from s asof left join q on s.user_id = q.user_id and s.start_time > q.posted_at"""
_DAILY = """daily as (select user_id, cast(ts as date) as day, count(*) as n,
 round(sum(value), 6) as total from events group by 1, 2)"""
O["trailing_day_load"] = f"""with {_DAILY} select a.user_id, a.day, a.n, {r("a.total", 4)} as total,
 {s("b.n")} as n_3d, {r("sum(b.total)", 4)} as total_3d
from daily a left join daily b on a.user_id = b.user_id and b.day < a.day
 and b.day >= a.day - interval 3 day group by a.user_id, a.day, a.n, a.total"""
O["load_before_events"] = f"""with {_DAILY} select e.event_id, e.user_id,
 cast(e.ts as date) as event_day, {s("b.n")} as n_3d
from events e left join daily b on e.user_id = b.user_id and b.day < cast(e.ts as date)
 and b.day >= cast(e.ts as date) - interval 3 day
where e.event_type = 'purchase' group by e.event_id, e.user_id, cast(e.ts as date)"""
O["latest_event_values"] = """select user_id,
 arg_max(value, struct_pack(a := ts, b := event_id)) filter (event_type = 'view') as view_value,
 arg_max(value, struct_pack(a := ts, b := event_id)) filter (event_type = 'click') as click_value
from events group by user_id"""

# --- appearances ------------------------------------------------------------------------------------

_RESULTS = f"""{PITCHES},
lastp as (select * from (select *, row_number() over (partition by game_pk
 order by at_bat_number desc, pitch_number desc) as rn from pitches) where rn = 1),
top1 as (select * from (select game_pk, pitcher, row_number() over (partition by game_pk
 order by at_bat_number, pitch_number) as rn from pitches
 where inning = 1 and inning_topbot = 'Top') where rn = 1),
bot1 as (select * from (select game_pk, pitcher, row_number() over (partition by game_pk
 order by at_bat_number, pitch_number) as rn from pitches
 where inning = 1 and inning_topbot = 'Bot') where rn = 1),
results as (select l.game_pk, l.game_date, l.home_team, l.away_team, l.home_score, l.away_score,
 t.pitcher as home_starter_id, b.pitcher as away_starter_id,
 case when l.home_score > l.away_score then 1.0e0 when l.away_score > l.home_score then 0.0e0 end
 as home_win, coalesce(l.home_score, 0) + coalesce(l.away_score, 0) as total_runs,
 {VENUE} as venue
 from lastp l left join top1 t using (game_pk) left join bot1 b using (game_pk))"""
O["game_results"] = f"with {_RESULTS} select * from results"
O["rest_days"] = f"""with {GAMES}, tg as (
 select game_date, game_pk, home_team as team from games
 union select game_date, game_pk, away_team from games)
select game_pk, team, cast(game_date - lag(game_date) over (partition by team
 order by game_date, game_pk) as int) as rest_days from tg"""

_PA = f"""pa0 as (select *, row_number() over (partition by game_pk, inning, inning_topbot,
 at_bat_number order by pitch_number desc) as rn from pitches where events in ({PA})),
pa1 as (select *, coalesce(home_score, 0) + coalesce(away_score, 0) as tot from pa0 where rn = 1),
pa2 as (select *, lag(tot) over (partition by game_pk order by at_bat_number, inning,
 inning_topbot) as before from pa1),
pa as (select game_pk, game_date, at_bat_number, inning, inning_topbot, pitcher, events,
 case when before is null then tot else greatest(tot - before, 0) end as runs_on_pa,
 {OUTS} as outs_on_pa, estimated_woba_using_speedangle as xwoba,
 case when launch_speed >= 98 and launch_angle between 22 and 36 then 1.0e0 else 0.0e0 end
 as barrel_flag,
 case when launch_speed >= 95 then 1.0e0 else 0.0e0 end as hard_flag from pa2)"""
O["plate_appearances"] = f"""with {PITCHES}, {_PA} select * replace ({r("xwoba", 6)} as xwoba)
from pa"""
_PG = f"""pg as (select game_pk, game_date, pitcher, count(*) as n_batters_faced,
 {s("outs_on_pa")} as outs, {n(f"events in ({STRIKEOUTS})")} as ks, {n("events = 'walk'")} as bbs,
 {n("events = 'hit_by_pitch'")} as hbps, {n(f"events in ({HITS})")} as hits_allowed,
 {n("events = 'home_run'")} as hrs_allowed, {s("runs_on_pa")} as runs, avg(xwoba) as xwoba,
 avg(barrel_flag) as barrel_rate, avg(hard_flag) as hard_contact_rate,
 sum(outs_on_pa) / 3.0e0 as ip from pa group by game_pk, game_date, pitcher)"""
O["pitcher_games"] = f"""with {PITCHES}, {_PA}, {_PG} select * replace ({r("xwoba", 6)} as xwoba,
 {r("barrel_rate", 6)} as barrel_rate, {r("hard_contact_rate", 6)} as hard_contact_rate,
 {r("ip", 6)} as ip) from pg"""
_POLD = ["outs", "runs", "ks", "bbs", "hits_allowed", "hrs_allowed", "hbps", "xwoba"]
_IP = "(sum(p_outs) over w / 3.0e0)"
_PRATES = f"""pl as (select game_pk, game_date, pitcher,
 {shifted(_POLD, "pitcher", "game_date, game_pk")} from pg),
prates as (select game_pk, game_date, pitcher,
 {d("sum(p_runs) over w", _IP)} * 9 as sp_era, {d("sum(p_ks) over w", _IP)} * 9 as sp_k9,
 {d("sum(p_bbs) over w", _IP)} * 9 as sp_bb9,
 {d("(sum(p_bbs) over w + sum(p_hits_allowed) over w)", _IP)} as sp_whip,
 {d("(13 * sum(p_hrs_allowed) over w + 3 * (sum(p_bbs) over w + sum(p_hbps) over w) "
    "- 2 * sum(p_ks) over w)", _IP)} as sp_fip,
 avg(p_xwoba) over w as sp_xwoba
 from pl window w as {frame("pitcher", "game_date, game_pk", 6)})"""
O["pitcher_rates"] = f"""with {PITCHES}, {_PA}, {_PG}, {_PRATES}
select game_pk, game_date, pitcher, {", ".join(f"{r(c)} as {c}" for c in
 ("sp_era", "sp_k9", "sp_bb9", "sp_whip", "sp_fip", "sp_xwoba"))} from prates"""
O["pitcher_rates_hot_keys"] = O["pitcher_rates"]

_COUNTS = ", ".join(f"{n(f"events = '{e}'")} as n_{e}" for e in
                    ("single", "double", "triple", "home_run", "walk", "hit_by_pitch"))
_WOBA = ("0.690e0 * n_walk + 0.722e0 * n_hit_by_pitch + 0.878e0 * n_single + 1.242e0 * n_double "
         "+ 1.568e0 * n_triple + 2.007e0 * n_home_run")
_TB = f"""tb0 as (select game_pk, game_date, {BAT} as team, {_COUNTS},
 {n(f"events in ({STRIKEOUTS})")} as n_strikeout, count(*) as n_pa, {n("stand = 'L'")} as n_lefty
 from pitches where events in ({PA}) group by 1, 2, 3),
tb as (select *, {d(f"({_WOBA})", "n_pa")} as woba,
 {d("(n_double + 2 * n_triple + 3 * n_home_run)", "(n_pa - n_walk - n_hit_by_pitch)")} as iso,
 {d("n_strikeout", "n_pa")} as k_rate, {d("n_walk", "n_pa")} as bb_rate,
 {d("n_lefty", "n_pa")} as lefty_share from tb0)"""
_RATES5 = ["woba", "iso", "k_rate", "bb_rate", "lefty_share"]
O["team_batting"] = f"""with {PITCHES}, {_TB} select * replace (
 {", ".join(f"{r(c)} as {c}" for c in _RATES5)}) from tb"""
_TBF = f"""tbl as (select game_pk, game_date, team,
 {shifted(_RATES5, "team", "game_date, game_pk")} from tb),
tbf as (select game_pk, game_date, team, avg(p_woba) over w as team_woba_30g,
 avg(p_iso) over w as team_iso_30g, avg(p_k_rate) over w as team_k_rate_30g,
 avg(p_bb_rate) over w as team_bb_rate_30g, avg(p_lefty_share) over w as lineup_lefty_share_30g
 from tbl window w as {frame("team", "game_date, game_pk", 30)})"""
O["team_batting_form"] = f"""with {PITCHES}, {_TB}, {_TBF} select game_pk, game_date, team,
 {", ".join(f"{r(c)} as {c}" for c in ("team_woba_30g", "team_iso_30g", "team_k_rate_30g",
 "team_bb_rate_30g", "lineup_lefty_share_30g"))} from tbf"""
_TCF = f"""tc as (select game_pk, game_date, {BAT} as team,
 avg(case when launch_speed >= 98 and launch_angle between 26 and 30 then 1.0e0 else 0.0e0 end)
 as barrel, avg(case when launch_speed >= 95 then 1.0e0 else 0.0e0 end) as hard,
 avg(launch_speed) as speed from pitches
 where description = 'hit_into_play' and launch_speed is not null group by 1, 2, 3),
tcl as (select *, {shifted(["barrel", "hard", "speed"], "team", "game_date, game_pk")} from tc),
tcf as (select game_pk, game_date, team, avg(p_barrel) over w as team_barrel_15g,
 avg(p_hard) over w as team_hardhit_15g, avg(p_speed) over w as team_exitvelo_15g
 from tcl window w as {frame("team", "game_date, game_pk", 15)})"""
O["team_contact_form"] = f"""with {PITCHES}, {_TCF} select game_pk, game_date, team,
 {", ".join(f"{r(c)} as {c}" for c in ("team_barrel_15g", "team_hardhit_15g",
 "team_exitvelo_15g"))} from tcf"""

_RELIEF = f"""relief as (select p.*, {FIELD} as team from
 (select p.*, home_starter_id, away_starter_id from pitches p join
  (select game_pk, home_starter_id, away_starter_id from results) using (game_pk)) p
 where (home_starter_id is null or pitcher <> home_starter_id)
 and (away_starter_id is null or pitcher <> away_starter_id))"""
_BG = f"""bg as (select game_pk, game_date, team, {s(OUTS)} as bullpen_outs,
 {n(f"events in ({STRIKEOUTS})")} as bullpen_ks, {n("events = 'walk'")} as bullpen_bbs,
 {n(f"events in ({HITS})")} as bullpen_hits,
 {n(f"events in ({HITS}, 'walk', 'hit_by_pitch')")} as bullpen_runs,
 sum({OUTS}) / 3.0e0 as bullpen_ip from relief where events in ({PA}) group by 1, 2, 3)"""
O["bullpen_games"] = f"""with {_RESULTS}, {_RELIEF}, {_BG}
select * replace ({r("bullpen_ip", 6)} as bullpen_ip) from bg"""
_BF = f"""bgl as (select game_pk, game_date, team, {shifted(
    ["bullpen_outs", "bullpen_bbs", "bullpen_hits", "bullpen_runs"], "team",
    "game_date, game_pk")} from bg),
bf as (select game_pk, game_date, team,
 {d("(sum(p_bullpen_bbs) over w + sum(p_bullpen_hits) over w)",
    "(sum(p_bullpen_outs) over w / 3.0e0)")} as bullpen_whip_10g,
 {d("sum(p_bullpen_runs) over w", "(sum(p_bullpen_outs) over w / 3.0e0)")} * 9
 as bullpen_era_10g from bgl window w as {frame("team", "game_date, game_pk", 10)})"""
O["bullpen_form"] = f"""with {_RESULTS}, {_RELIEF}, {_BG}, {_BF} select game_pk, game_date, team,
 {r("bullpen_whip_10g", 6)} as bullpen_whip_10g, {r("bullpen_era_10g", 6)} as bullpen_era_10g
from bf"""
_BD = f"""bd as (select game_date as day, team, count(*) as pitches, {s(OUTS)} as outs
 from relief group by 1, 2)"""
O["bullpen_days"] = f"with {_RESULTS}, {_RELIEF}, {_BD} select * from bd"


def _load(games: str) -> str:
    return f"""tgs as (select game_pk, game_date, home_team as team from {games}
 union all select game_pk, game_date, away_team from {games}),
bl as (select g.game_pk, g.team, {s("b.pitches")} as bullpen_pitches_3d,
 sum(b.outs) / 3.0e0 as bullpen_ip_3d from tgs g left join bd b on b.team = g.team
 and b.day < g.game_date and b.day >= g.game_date - interval 3 day group by 1, 2)"""


O["bullpen_load"] = f"""with {_RESULTS}, {_RELIEF}, {_BD}, {GAMES}, {_load("games")}
select game_pk, team, bullpen_pitches_3d, {r("bullpen_ip_3d", 6)} as bullpen_ip_3d from bl"""

_PS = f"""ps as (select game_pk, game_date, pitcher, count(*) as n_pitches,
 {n("description in ('swinging_strike', 'swinging_strike_blocked')")} as whiffs,
 avg(case when pitch_type in ('FF', 'SI', 'FT') then release_speed end) as fb_velo,
 avg(case when pitch_type in ('FF', 'SI', 'FT') then 1.0e0 else 0.0e0 end) as fb_pct,
 avg(case when events in ({PA}) and stand = 'L' then estimated_woba_using_speedangle end)
 as xwoba_vs_l,
 avg(case when events in ({PA}) and stand = 'R' then estimated_woba_using_speedangle end)
 as xwoba_vs_r from pitches group by 1, 2, 3)"""
_PSC = ["fb_velo", "fb_pct", "xwoba_vs_l", "xwoba_vs_r"]
O["pitcher_stuff"] = f"""with {PITCHES}, {_PS} select * replace (
 {", ".join(f"{r(c)} as {c}" for c in _PSC)}) from ps"""
_PSF = f"""psl as (select game_pk, game_date, pitcher, {shifted(
    [*_PSC, "whiffs", "n_pitches"], "pitcher", "game_date, game_pk")} from ps),
psf as (select game_pk, game_date, pitcher, avg(p_fb_velo) over w as sp_fbvelo_3g,
 avg(p_fb_pct) over w as sp_fbpct_3g,
 {d("sum(p_whiffs) over w", "sum(p_n_pitches) over w")} as sp_whiff_3g,
 avg(p_xwoba_vs_l) over a as sp_xwoba_vs_l, avg(p_xwoba_vs_r) over a as sp_xwoba_vs_r
 from psl window w as {frame("pitcher", "game_date, game_pk", 3)},
 a as (partition by pitcher order by game_date, game_pk
  rows between unbounded preceding and current row))"""
O["pitcher_stuff_form"] = f"""with {PITCHES}, {_PS}, {_PSF} select game_pk, game_date, pitcher,
 {", ".join(f"{r(c)} as {c}" for c in ("sp_fbvelo_3g", "sp_fbpct_3g", "sp_whiff_3g",
 "sp_xwoba_vs_l", "sp_xwoba_vs_r"))} from psf"""
O["pitcher_stuff_hot_keys"] = O["pitcher_stuff_form"]

_BATG = f"""batg as (select game_pk, game_date, {BAT} as team, batter, {_COUNTS},
 {n(f"events in ({STRIKEOUTS})")} as n_strikeout, count(*) as n_pa
 from pitches where events in ({PA}) group by 1, 2, 3, 4)"""
O["batter_games"] = f"with {PITCHES}, {_BATG} select * from batg"
_BATF = f"""batn as (select *, {_WOBA} as num, n_pa - n_walk - n_hit_by_pitch as atb from batg),
batl as (select game_pk, game_date, team, batter, {shifted(["num", "atb", "n_pa"], "batter",
 "game_date, game_pk, team")} from batn),
batf as (select game_pk, game_date, team, batter, sum(p_num) over w as woba_num,
 {s("p_atb").replace("sum(p_atb)", "sum(p_atb) over w")} as ab,
 {s("p_n_pa").replace("sum(p_n_pa)", "sum(p_n_pa) over w")} as pa_30g
 from batl window w as {frame("batter", "game_date, game_pk, team", 30)})"""
O["batter_form"] = f"""with {PITCHES}, {_BATG}, {_BATF}
select * replace ({r("woba_num", 6)} as woba_num) from batf"""
_LG = f"""lgd as (select game_date, sum(woba_num) as a, sum(ab) as b from batf group by 1),
lg as (select game_date, {d("sum(a) over (order by game_date)", "sum(b) over (order by game_date)")}
 as lg_woba from lgd)"""
O["league_mean"] = f"""with {PITCHES}, {_BATG}, {_BATF}, {_LG}
select game_date, {r("lg_woba", 6)} as lg_woba from lg"""
_RAT = """rat as (select game_pk, f.game_date, team, batter, pa_30g,
 case when coalesce(ab, 0) > 0 then (woba_num + coalesce(lg_woba, 0.315e0) * 120) / (ab + 120) end
 as shrunk_woba from batf f left join lg on f.game_date = lg.game_date)"""
O["batter_ratings"] = f"""with {PITCHES}, {_BATG}, {_BATF}, {_LG}, {_RAT}
select * replace ({r("shrunk_woba", 6)} as shrunk_woba) from rat"""
_LINE = """lined as (select *, row_number() over (partition by game_pk, team
 order by pa_30g desc, batter) as rn from rat where shrunk_woba is not null),
lineup as (select game_pk, team, avg(shrunk_woba) as lineup_woba_mean,
 avg(case when rn <= 3 then shrunk_woba end) as lineup_woba_top3,
 stddev_samp(shrunk_woba) as lineup_woba_std from lined where rn <= 9 group by 1, 2)"""
O["lineups"] = f"""with {PITCHES}, {_BATG}, {_BATF}, {_LG}, {_RAT}, {_LINE}
select game_pk, team, {r("lineup_woba_mean", 6)} as lineup_woba_mean,
 {r("lineup_woba_top3", 6)} as lineup_woba_top3, {r("lineup_woba_std", 6)} as lineup_woba_std
from lineup"""

# --- one row per game, one row per pitch ------------------------------------------------------------

_REST = """restd as (select game_pk, team, cast(game_date - lag(game_date) over (partition by team
 order by game_date, game_pk) as int) as rest_days from (
 select game_date, game_pk, home_team as team from results
 union select game_date, game_pk, away_team from results))"""
_SP = ["sp_era", "sp_k9", "sp_bb9", "sp_whip", "sp_fip", "sp_xwoba"]
_STUFF = ["sp_fbvelo_3g", "sp_fbpct_3g", "sp_whiff_3g", "sp_xwoba_vs_l", "sp_xwoba_vs_r"]
_TEAM = [("tbf", ["team_woba_30g", "team_iso_30g", "team_k_rate_30g", "team_bb_rate_30g"]),
         ("bf", ["bullpen_whip_10g", "bullpen_era_10g"]),
         ("tcf", ["team_barrel_15g", "team_hardhit_15g", "team_exitvelo_15g"]),
         ("bl", ["bullpen_pitches_3d", "bullpen_ip_3d"]),
         ("lineup", ["lineup_woba_mean", "lineup_woba_top3", "lineup_woba_std"]),
         ("restd", ["rest_days"])]
_INTS = ("bullpen_pitches_3d", "rest_days")


def _game_features() -> str:
    cols, joins = [], []
    for side, other in (("home", "away"), ("away", "home")):
        for t, names in [*_TEAM, ("prates", _SP), ("psf", _STUFF)]:
            a = f"{t}_{side}"
            on = (f"{a}.pitcher = w.{side}_starter_id" if t in ("prates", "psf")
                  else f"{a}.team = w.{side}_team")
            joins.append(f"left join {t} {a} on {a}.game_pk = w.game_pk and {on}")
            cols += [f"{a}.{c} as {c}_{side}" if c in _INTS
                     else f"{r(f'{a}.{c}', 5)} as {c}_{side}" for c in names]
        joins.append(f"left join tbf opp_{side} on opp_{side}.game_pk = w.game_pk "
                     f"and opp_{side}.team = w.{other}_team")
        cols.append(f"{r(f'opp_{side}.lineup_lefty_share_30g', 5)} as opp_lefty_share_{side}")
    parts = [_RESULTS, _PA, _PG, _PRATES, _TB, _TBF, _TCF, _RELIEF, _BG, _BF, _BD,
             _load("results"), _PS, _PSF, _BATG, _BATF, _LG, _RAT, _LINE, _REST]
    return (f"with {', '.join(parts)} select w.*, {', '.join(cols)} from results w "
            + " ".join(joins))


O["game_features"] = _game_features()


def _family(types: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in types)


_RISP = "(case when on_2b is null then 0 else 1 end + case when on_3b is null then 0 else 1 end)"
O["pitch_features"] = f"""with {PITCHES}, gf as ({O["game_features"]}) select p.game_pk, p.at_bat_number, p.pitch_number,
 (case when on_1b is null then 0 else 1 end) + {_RISP} as bases_loaded,
 {_RISP} as runners_in_scoring_position, {_RISP} > 0 as is_risp,
 coalesce(p.home_score, 0) - coalesce(p.away_score, 0) as score_diff,
 case when inning_topbot = 'Top' then p.away_team else p.home_team end as batting_team,
 cast(row_number() over (partition by p.game_pk, p.at_bat_number order by p.pitch_number) as int)
 as ab_pitch_count, cast(ceil(p.at_bat_number / 9.0e0) as int) as times_through_order,
 case when stand = p_throws then 'same' else 'opposite' end as lr_matchup,
 {r("launch_speed", 5)} as exit_velocity, {r("launch_angle", 5)} as launch_angle_f,
 case when pitch_type in ({_family(K.PITCH_CATEGORIES["fastball"])}) then 'fastball'
  when pitch_type in ({_family(K.PITCH_CATEGORIES["breaking"])}) then 'breaking'
  when pitch_type in ({_family(K.PITCH_CATEGORIES["offspeed"])}) then 'offspeed'
  else 'unknown' end as pitch_category,
 {", ".join(f"gf.{c}" for c in PITCH_ROW_FEATURES)} from pitches p left join gf on p.game_pk = gf.game_pk"""

# --- ratings and records ----------------------------------------------------------------------------


def _elo(where: str = "true") -> str:
    """A recursive walk over each league's games that carries all thirty ratings as a list."""
    league = "cast(cast(floor(o_custkey / 30) as bigint) as varchar)"
    return f"""g as (select {league} as league, row_number() over (
 partition by {league} order by cast(o_orderdate as date), o_orderkey) as seq,
 o_orderkey as game_pk, year(o_orderdate) as yr, o_custkey % 30 as h,
 (o_custkey % 30 + 1 + o_orderkey % 29) % 30 as a,
 case o_orderstatus when 'F' then 1.0e0 when 'O' then 0.0e0 end as won from orders where {where}),
walk as (select league, cast(0 as bigint) as seq, cast(null as bigint) as game_pk,
 cast(null as bigint) as yr, cast(null as double) as he, cast(null as double) as ae,
 list_transform(range(30), lambda x: 1500.0e0) as elo from (select distinct league from g)
 union all
 select league, seq, game_pk, yr, he, ae, case when won is null then base else list_transform(base,
  lambda e, i: case when i - 1 = h then e + 20 * (won - ex)
   when i - 1 = a then e + 20 * ((1 - won) - (1 - ex)) else e end) end
 from (select *, 1.0e0 / (1.0e0 + power(10.0e0, (ae - he - 65) / 400)) as ex from (
  select *, base[h + 1] as he, base[a + 1] as ae from (
   select w.league, g.seq, g.game_pk, g.yr, g.h, g.a, g.won,
    case when w.yr <> g.yr then list_transform(w.elo, lambda e: e + (1500.0e0 - e) / 3)
     else w.elo end as base from walk w join g on g.league = w.league and g.seq = w.seq + 1))))"""


O["elo_entering"] = f"""with recursive {_elo()} select game_pk, {r("he", 4)} as home_elo,
 {r("ae", 4)} as away_elo from walk where game_pk is not null"""
O["elo_by_season"] = O["elo_entering"]
O["elo_resumed"] = O["elo_entering"] + f""" and game_pk in (select o_orderkey from orders
 where o_orderdate >= timestamp '{SPLIT_DAY}')"""
O["elo_as_of"] = f"""with recursive {_elo("o_orderdate < timestamp '2000-06-15'")},
fin as (select * from walk where (league, seq) in (select (league, max(seq)) from g group by league)),
played as (select distinct league, h as t from g where won is not null
 union select distinct league, a from g where won is not null)
select p.league, 'T' || p.t as team, {r("fin.elo[p.t + 1]", 4)} as elo
from played p join fin using (league)"""

_RES = f"""{GAMES}, {SIDES}, res as (select *,
 case when home_win is null then 0 when side = 'home' then home_win else 1 - home_win end as w,
 case when home_win is null then 0 when side = 'home' then 1 - home_win else home_win end as l,
 case when home_win is null then 0 when side = 'home' then home_score else away_score end as rs,
 case when home_win is null then 0 when side = 'home' then away_score else home_score end as ra
 from sides)"""
O["records_entering"] = f"""with {_RES}, c as (select game_pk, side, team,
 coalesce(sum(w) over x, 0) as wins, coalesce(sum(l) over x, 0) as losses,
 coalesce(sum(rs) over x, 0) - coalesce(sum(ra) over x, 0) as diff from res
 window x as (partition by team, season order by game_date, game_pk, side
  rows between unbounded preceding and 1 preceding))
select game_pk, side, team, cast(wins as bigint) as wins, cast(losses as bigint) as losses,
 {even(d("wins", "(wins + losses)"), 3)} as win_pct, cast(diff as bigint) as run_diff,
 cast(wins as bigint) || '-' || cast(losses as bigint) as record from c"""
O["records_entering_hot_keys"] = O["records_entering"]
O["final_records"] = f"""with {_RES} select team, {s("w")} as wins, {s("l")} as losses,
 {s("rs")} as runs_scored, {s("ra")} as runs_allowed from res where home_win is not null
 and season = (select max(season) from games where home_win is not null) group by team"""
O["last_played"] = f"""with {GAMES}, {SIDES} select team, max(game_date) as last_played
from sides group by team"""
_TEN = """ten as (select team, cast(sum(w) as bigint) as l10_wins, cast(sum(l) as bigint) as l10_losses
 from (select *, row_number() over (partition by team order by game_date desc, game_pk desc) as rn
 from res where home_win is not null) where rn <= 10 group by team)"""
O["last_ten"] = f"with {_RES}, {_TEN} select * from ten"
_POWER = f"""{_RES}, {_TEN},
el as (select home_team as team, avg(e) as m, arg_max(e, struct_pack(a := game_date, b := game_pk))
 as z from (select *, 1400.0e0 + cast(floor(o_totalprice / 1000) as bigint) % 200 as e from games)
 group by 1),
tot as (select team, {s("w")} as wins, {s("l")} as losses,
 sum(case when side = 'home' then w end) as hw,
 sum(case when side = 'home' and home_win is not null then 1 else 0 end) as hn,
 sum(case when side = 'away' then w end) as aw,
 sum(case when side = 'away' and home_win is not null then 1 else 0 end) as an
 from res group by team),
pw as (select team, team as team_name, {even("m", 1)} as elo, {even("z", 1)} as elo_latest, wins,
 losses, wins || '-' || losses as record,
 {even(f"coalesce({d('wins', '(wins + losses)')}, 0)", 3)} as pct, 0 as run_diff,
 coalesce(l10_wins, 0) || '-' || coalesce(l10_losses, 0) as l10,
 {even(f"coalesce({d('hw', 'hn')}, 0)", 3)} as home_pct,
 {even(f"coalesce({d('aw', 'an')}, 0.5)", 3)} as away_pct
 from el join tot using (team) left join ten using (team)),
pr as (select *, cast(row_number() over (order by elo desc, team) as int) as rank from pw)"""
O["power_rankings"] = f"with {_POWER} select * from pr"
O["top_teams"] = f"""with {_POWER} select rank, team, elo, record from pr where rank <= 15"""

# --- slate ------------------------------------------------------------------------------------------

_HIST = f"""{GAMES}, hist as (select *,
 case when game_pk % 3 = 0 then o_totalprice end as woba_30g_home,
 case when game_pk % 4 = 0 then o_totalprice / 2 end as woba_30g_away,
 case when game_pk % 5 = 0 then o_totalprice / 4 end as sp_era_home,
 case when game_pk % 2 = 0 then o_totalprice / 8 end as sp_era_away,
 case when game_pk % 7 = 0 then prob end as opp_lefty_share_home,
 case when game_pk % 6 = 0 then prob / 2 end as opp_lefty_share_away
 from games where game_date < date '{SLATE_DAY}')"""


def _latest(name: str, pairs: list[tuple[str, str]], key: str, value: str) -> str:
    union = " union all ".join(
        f"select game_date, game_pk, {k} as {key}, {v} as v from hist" for k, v in pairs)
    return (f"{name} as (select {key}, v as {value} from (select *, row_number() over (partition by "
            f"{key} order by game_date desc, game_pk desc) as rn from ({union}) where v is not null) "
            f"where rn = 1)")


_WOBA_STATE = _latest("wst", [("home_team", "woba_30g_home"), ("away_team", "woba_30g_away")],
                      "team", "woba_30g")
_ERA_STATE = _latest("est", [("home_starter_id", "sp_era_home"), ("away_starter_id", "sp_era_away")],
                     "pitcher", "sp_era")
_LEFTY = ", ".join([
    _latest("lh", [("home_team", "opp_lefty_share_away")], "team", "a"),
    _latest("la", [("away_team", "opp_lefty_share_home")], "team", "b"),
    "lefty as (select t.team, coalesce(b, a) as lefty_share from (select distinct team from (select "
    "home_team as team from hist union select away_team from hist)) t left join lh using (team) "
    "left join la using (team))"])
O["team_state"] = f"""with {_HIST}, {_WOBA_STATE} select t.team, woba_30g from
 (select home_team as team from hist union select away_team from hist) t
 left join wst using (team)"""
O["pitcher_state"] = f"""with {_HIST}, {_ERA_STATE} select t.pitcher, sp_era from
 (select home_starter_id as pitcher from hist union select away_starter_id from hist) t
 left join est using (pitcher)"""
O["own_lefty_share"] = f"with {_HIST}, {_LEFTY} select * from lefty"
_NAMES = """names as (select name_key, pitcher from (select 'first last' || pitcher as name_key,
 pitcher, row_number() over (partition by pitcher order by game_date desc, game_pk desc) as rn
 from pitches) where rn = 1)"""
O["name_crosswalk"] = f"with {PITCHES}, {_NAMES} select * from names"


def _slate() -> str:
    cols, joins = [], []
    for side, other in (("home", "away"), ("away", "home")):
        joins += [f"left join rec r{side} on r{side}.team = s.{side}_team",
                  f"left join lp l{side} on l{side}.team = s.{side}_team",
                  f"left join wst w{side} on w{side}.team = s.{side}_team",
                  f"left join lefty y{side} on y{side}.team = s.{side}_team",
                  f"left join names n{side} on n{side}.pitcher = s.{side}_starter_id",
                  f"left join est e{side} on e{side}.pitcher = n{side}.pitcher"]
        cols += [f"coalesce(r{side}.w, 0) || '-' || coalesce(r{side}.l, 0) as {side}_record",
                 f"{r(f'r{side}.pct')} as {side}_win_pct",
                 f"coalesce(r{side}.diff, 0) as {side}_run_diff",
                 f"cast(greatest(date '{SLATE_DAY}' - l{side}.last_played, 1) as int) "
                 f"as rest_days_{side}",
                 f"{r(f'w{side}.woba_30g')} as woba_30g_{side}",
                 f"{r(f'y{side}.lefty_share')} as opp_lefty_share_{other}",
                 f"{r(f'e{side}.sp_era')} as sp_era_{side}"]
    return f"""with {PITCHES}, {_NAMES}, {_HIST}, {_WOBA_STATE}, {_ERA_STATE}, {_LEFTY},
hs as (select *, 'home' as side, home_team as team from hist
 union all select *, 'away' as side, away_team as team from hist),
rec as (select team, {n("(side = 'home') = (home_win = 1)")} as w,
 {n("(side = 'home') <> (home_win = 1)")} as l,
 {even(d("sum(case when (side = 'home') = (home_win = 1) then 1 else 0 end)", "count(*)"), 3)}
 as pct, cast(sum((home_score - away_score) * case when side = 'home' then 1 else -1 end)
 as bigint) as diff from hs where home_win is not null and season = (select max(season) from hist
 where home_win is not null) group by team),
lp as (select team, max(game_date) as last_played from hs group by team)
select '{SLATE_DAY.replace("-", "")}_' || s.away_team || '@' || s.home_team as game_id,
 s.game_date, cast(s.game_date as timestamp) + interval 19 hours as start_time_utc,
 s.home_team, s.away_team, {", ".join(cols)}, cast(null as double) as home_win
from games s {" ".join(joins)} where s.game_date = date '{SLATE_DAY}'"""


O["upcoming_slate"] = _slate()

# --- metrics ----------------------------------------------------------------------------------------

_EDGES = [i * 0.1 for i in range(10)] + [1.0]
_TENTH = "case " + " ".join(
    f"when q >= {a:.17e} and q < {b:.17e} then {i}" for i, (a, b) in
    enumerate(zip(_EDGES, _EDGES[1:]))) + " end"
_SCORED = f"""{GAMES}, sc as (select *, least(greatest(prob, 1e-7), 1 - 1e-7) as q,
 cast(home_win as double) as y from games where home_win is not null)"""


def _metrics(keys: str) -> str:
    """Mann-Whitney AUC from average ranks, plain averages, and ECE from bins."""
    by = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    group = f"group by {keys}" if keys else ""
    using = f"using ({keys})" if keys else "on true"
    sel = f"a.{keys}, " if keys else ""
    return f"""rk as (select {by} y, q, rank() over ({part} order by q)
  + (count(*) over (partition by {by} q) - 1) / 2.0e0 as rnk, {_TENTH} as b from sc),
m1 as (select {by} count(*) as n, case when sum(y) = 0 or sum(y) = count(*) then 0.5e0 else
  (sum(case when y = 1 then rnk end) - sum(y) * (sum(y) + 1) / 2)
  / (sum(y) * (count(*) - sum(y))) end as auc,
  avg((q - y) * (q - y)) as brier, -avg(y * ln(q) + (1 - y) * ln(1 - q)) as logloss
  from rk {group}),
m2 as (select {by} sum(c * abs(acc - conf)) / sum(c) as ece from (select {by} b, count(*) as c,
  avg(y) as acc, avg(q) as conf from rk group by {by} b) {group}),
mm as (select {sel} n, {r("auc")} as auc, {r("brier")} as brier,
  {r("logloss")} as logloss, {r("ece")} as ece
  from m1 a join m2 b {using})"""


O["pooled_metrics"] = f"""with {_SCORED}, {_metrics("")}
select n, auc, brier, logloss, ece from mm"""
O["season_metrics"] = f"""with {_SCORED}, {_metrics("season")}
select season, n, auc, brier, logloss, ece from mm"""
O["auc_by_league"] = f"""with {_SCORED}, {_metrics("league")}
select league, auc from mm"""


def _buckets(keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    edges = [0.5 + i * 0.1 for i in range(5)] + [1.0]
    which = "case " + " ".join(
        f"when f >= {a:.17e} and f {'<=' if i == 4 else '<'} {b:.17e} then {i}"
        for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " end"
    return f"""fv as (select *, greatest(prob, 1 - prob) as f,
  case when prob >= 0.5 then y else 1 - y end as fw from sc),
bk as (select {by} (50 + 10 * b) || '–' || (60 + 10 * b) || '%' as bucket,
  avg(f) as mean_predicted, avg(fw) as mean_actual, count(*) as count
  from (select *, {which} as b from fv) group by {by} b),
bkg as (select {by} bucket, {r("mean_predicted")} as mean_predicted,
  {r("mean_actual")} as mean_actual, count, {r("mean_predicted - mean_actual")} as gap from bk)"""


O["calibration_buckets"] = f"with {_SCORED}, {_buckets()} select * from bkg"
O["reliability_total"] = f"""with {_SCORED}, {_buckets()}, t as (
 select bucket, mean_predicted, mean_actual, count from bk union all
 select 'TOTAL', sum(mean_predicted * count) / sum(count), sum(mean_actual * count) / sum(count),
 cast(sum(count) as bigint) from bk)
select bucket, {r("mean_predicted", 6)} as mean_predicted, {r("mean_actual", 6)} as mean_actual,
 count, {r("mean_predicted - mean_actual")} as gap from t"""
_DAYSC = f"""{GAMES}, sc as (select *, least(greatest(prob, 1e-7), 1 - 1e-7) as q,
 cast(home_win as double) as y, strftime(game_date, '%Y%m%d') as date from games
 where home_win is not null)"""
O["daily_calibration"] = f"""with {_DAYSC}, {_metrics("date")}, {_buckets("date")},
c as (select date, count(*) as n_games, {n("home_win = 1")} as home_wins,
 {n("home_win = 0")} as home_losses, {n("(prob >= 0.5) = (home_win = 1)")} as picks_correct
 from sc group by date)
select c.*, mm.auc, mm.brier, mm.logloss, mm.ece, bkg.bucket, mean_predicted, mean_actual, gap,
 bkg.count as bucket_count from c join mm using (date) join bkg using (date)"""
O["rolling_brier"] = f"""with {_SCORED}, dd as (select game_date as date,
 sum((prob - y) * (prob - y)) as e, count(*) as c from sc group by 1)
select a.date, {s("b.c")} as n, {r("sum(b.e) / sum(b.c)")} as brier, 0.23e0 as baseline
from dd a join dd b on b.date <= a.date and b.date > a.date - interval 30 day group by a.date"""
_PICK = "case when prob >= 0.5 then home_team when prob < 0.5 then away_team end"
_WIN = "case when home_win = 1 then home_team when home_win = 0 then away_team end"
O["prediction_history"] = f"""with {GAMES}
select strftime(game_date, '%Y%m%d') || '_' || away_team || '@' || home_team as game_id, game_pk,
 game_date, home_team, away_team, home_score, away_score, home_win, prob, {_PICK} as model_pick,
 {_WIN} as actual_winner, case when (prob >= 0.5) = (home_win = 1) then 1 else 0 end as correct,
 greatest(prob, 1 - prob) as pick_prob from games where home_win is not null"""
_FULL = "case {0} " + " ".join(
    "when '{}' then '{}'".format(t, v) for t, v in K.TEAM_NAMES.items()) + " else '' end"


def _display(src: str) -> str:
    wp = "case when home_win = 1 then prob else 1 - prob end"
    return f"""disp as (select *, case when start_time_utc > timestamp '1999-06-01 00:00:00'
  then 'Scheduled' when home_win is not null then 'Final' else 'Live' end as game_status,
 {_PICK} as model_pick, home_win is not null and {_PICK} = {_WIN} as model_correct,
 home_win is not null and {wp} <= 0.35 as is_upset, abs(prob - 0.5) < 0.02 as is_coin_flip,
 {wp} as wp, {_WIN} as won from {src})"""


O["display_games"] = f"""with {GAMES}, dg as (select game_pk, home_win, prob,
 {_code("game_pk")} as home_team, {_code("(game_pk + 3)")} as away_team,
 cast(game_date as timestamp) + interval 14 hours + to_hours(cast(game_pk % 14 as int))
 as start_time_utc from games), {_display("dg")},
loc as (select *, hour(timezone('America/New_York', timezone('UTC', start_time_utc))) >= 19 as ev
 from disp)
select game_pk, game_status, ev as evening_game, not ev as day_game,
 {_FULL.format("home_team")} as home_team_name, {_FULL.format("away_team")} as away_team_name,
 model_pick, model_correct, is_upset, is_coin_flip from loc"""
_SHOWN = f"""{GAMES}, sg as (select *, cast(game_date as timestamp) + interval 19 hours
 as start_time_utc from games), {_display("sg")}"""
O["status_summary"] = f"""with {_SHOWN} select count(*) as all_games,
 count_if(game_status = 'Final') as final, count_if(game_status = 'Live') as live,
 count_if(model_correct) as wins, count_if(home_win is not null and not model_correct) as losses,
 count_if(home_win is not null) as completed, count_if(is_upset) as upsets from disp"""
O["upset_list"] = f"""with {_SHOWN} select game_pk, won as team, {r("wp", 6)} as prob from disp
where is_upset"""
O["filled_scores"] = f"with {GAMES} select game_pk, home_score, away_score from games"


def _implied(line: str) -> str:
    return (f"case when {line} < 0 then -{line} / (-{line} + 100.0e0) "
            f"else 100.0e0 / ({line} + 100.0e0) end")


O["market_edges"] = f"""with {GAMES}, ml as (select game_pk, prob,
 case when game_pk % 5 > 0 then cast(100 + game_pk % 90 as int)
  * case when game_pk % 2 = 0 then -1 else 1 end end as moneyline_home,
 case when game_pk % 7 > 0 then cast(-110 - game_pk % 60 as int) end as moneyline_away from games),
f as (select *, {_implied("coalesce(moneyline_home, -110)")} as h,
 {_implied("coalesce(moneyline_away, -110)")} as a from ml)
select game_pk, prob as home_win_prob_model, moneyline_home, moneyline_away,
 {even("prob - h / (h + a)", 4)} as edge_home, {even("1 - prob - a / (h + a)", 4)} as edge_away
from f"""
O["american_lines"] = f"""with {GAMES}, ml as (select game_pk, cast(case when prob >= 0.5
 then round_even(-100 * prob / (1 - prob), 0) when prob > 0 then round_even(100 * (1 - prob) / prob, 0)
 end as int) as line from games)
select game_pk, line, {r(_implied("line"))} as back from ml"""

O["range_accuracy"] = f"""with {GAMES} select count(*) as n_games, {even("100.0e0 * avg("
 "case when (prob >= 0.5) = (home_win = 1) then 1 else 0 end)", 1)} as accuracy_pct from games
where home_win is not null and game_date between date '1996-01-01' and date '1999-12-31'"""
_EASTERN = "timezone('America/New_York', timezone('UTC', ts))"
O["local_times"] = f"""select event_id, {_EASTERN} as eastern, hour({_EASTERN}) >= 19 as evening,
 ts as back from events"""
O["event_properties"] = """select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0)
 as k, 'none' as note from events"""

# --- folds ------------------------------------------------------------------------------------------


def _folds(cadence: int, start: int) -> str:
    return f"""{GAMES}, dec as (select * from games where home_win is not null),
dates as (select game_date, row_number() over (order by game_date) - 1 as i from
 (select distinct game_date from dec)),
fd as (select game_date, case when i >= {start} then cast(floor((i - {start}) / {cadence}.0e0) as int)
 end as fold_idx from dates),
ft as (select fold_idx, min(game_date) as val_start, max(game_date) as val_end from fd
 where fold_idx is not null group by 1),
fs as (select ft.*, (select count(*) from dec where game_date < val_start) as n_train,
 (select count(*) from dec where game_date between val_start and val_end) as n_val from ft)"""


O["fold_table"] = f"with {_folds(7, 30)} select * from fs"
O["recent_folds"] = f"""with {_folds(10, 10)} select * from fs
where fold_idx > (select max(fold_idx) from fs) - 25"""
O["fold_of_game"] = f"""with {_folds(7, 7)} select game_pk, fold_idx from dec
left join fd using (game_date)"""

# --- drift ------------------------------------------------------------------------------------------

_QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
O["quantiles"] = " union all ".join(
    f"select '{c}' as feature, count({c}) as n, " + ", ".join(
        f"{r(f'quantile_cont({c}, {q})')} as q{i}" for i, q in enumerate(_QS))
    + " from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
O["column_medians"] = f"""select 'l_quantity' as feature, {r("median(l_quantity)")} as median
from lineitem union all select 'some', {r("median(case when l_partkey % 3 = 0 "
 "then l_extendedprice end)")} from lineitem union all select 'none', 0.0e0"""
_WINDOWS = f"""{GAMES}, dec as (select * from games where home_win is not null),
ranked as (select *, game_date >= date '1999-09-02' as cur, row_number() over (
 partition by game_date >= date '1999-09-02' order by game_date desc, game_pk desc) as rn from dec),
win as (select * from ranked where cur
 or rn <= greatest(3 * (select count(*) from ranked where cur), 250))"""
_LONG = _WINDOWS + ", long as (" + " union all ".join(
    f"select '{name}' as feature, cur, cast({expr} as double) as v from win "
    f"where ({expr}) is not null" for name, expr in (
        ("o_totalprice", "o_totalprice"), ("prob", "prob"), ("home_score", "home_score"),
        ("away_score", "away_score"),
        ("starter", "case when game_pk % 4 > 0 then home_starter_id end"))) + ")"
_PSI = f"""{_LONG},
qe as (select feature, list_sort(list_distinct(list_transform(quantile_cont(v,
 [{", ".join(str(i / 10) for i in range(11))}]), lambda e: round(e, 9)))) as ed from long group by 1),
bn as (select feature, cur, greatest(1, least(len(ed) - 1,
 len(list_filter(ed, lambda e: e <= v)))) as b from long join qe using (feature)),
bins as (select feature, len(ed) - 1 as k, unnest(range(1, len(ed))) as b from qe),
cnt as (select i.feature, i.k, i.b, count_if(cur) as c, count_if(not cur) as o from bins i
 left join bn x on x.feature = i.feature and x.b = i.b group by 1, 2, 3),
sh as (select *, (c + 0.5e0) / (sum(c) over f + 0.5e0 * k) as pc,
 (o + 0.5e0) / (sum(o) over f + 0.5e0 * k) as pb from cnt window f as (partition by feature)),
psi as (select feature, {even("greatest(sum((pc - pb) * ln(pc / pb)), 0)", 6)} as psi from sh
 group by 1)"""
O["population_stability"] = f"with {_PSI} select * from psi"
_DRIFT = f"""{_PSI}, st as (select feature, count_if(not cur) as nb, count_if(cur) as nc,
 avg(v) filter (not cur) as mb, avg(v) filter (cur) as mc, var_samp(v) filter (not cur) as vb,
 var_samp(v) filter (cur) as vc from long group by 1),
dr as (select *, 4.5e0 * (1.0e0 / nb + 1.0e0 / nc) as noise,
 greatest(psi - 4.5e0 * (1.0e0 / nb + 1.0e0 / nc), 0) as adj, mc - mb as shift,
 sqrt(((nb - 1) * vb + (nc - 1) * vc) / (nb + nc - 2)) * sqrt(1.0e0 / nb + 1.0e0 / nc) * 1.5e0 as se
 from st join psi using (feature)),
dz as (select feature, {even("mc", 4)} as current_mean, {even("mb", 4)} as baseline_mean, psi,
 {even("adj", 6)} as psi_adjusted, {even("noise", 6)} as noise_floor,
 {even("shift", 6)} as mean_shift, {even("se", 6)} as shift_se,
 case when se > 0 then abs(shift) > 2 * se else adj > 0 end as location_shift,
 case when nb < 100 or nc < 30 then 'INSUFFICIENT'
  when not (case when se > 0 then abs(shift) > 2 * se else adj > 0 end) then 'OK'
  when adj >= 0.25 then 'ALERT' when adj >= 0.1 then 'WARN' else 'OK' end as status,
 nb as n_baseline, nc as n_current from dr)"""
O["feature_drift"] = f"with {_DRIFT} select * from dz"
O["drift_flags"] = f"""with {_DRIFT} select count_if(status = 'WARN') as warnings,
 count_if(status = 'ALERT') as alerts, coalesce(string_agg(case when status in ('WARN', 'ALERT')
 then feature end, ',' order by feature), '') as features from dz"""
O["drift_baseline"] = f"""with {GAMES}, dec as (select * from games where home_win is not null),
cur as (select game_pk from dec where game_date >= date '1999-09-02'),
old as (select game_pk, row_number() over (order by game_date desc, game_pk desc) as rn from dec
 where game_date < date '1999-09-02')
select game_pk, 'current' as part from cur union all
select game_pk, 'baseline' from old where rn <= greatest(3 * (select count(*) from cur), 250)"""
O["drift_baseline_of_names"] = f"""with {GAMES}, dec as (select *, 'g' || game_pk as name from games
 where home_win is not null), old as (select name, row_number() over (order by game_date desc,
 name desc) as rn from dec where game_date < date '1999-09-02')
select name as game_pk from old where rn <= greatest(3 * (select count(*) from dec
 where game_date >= date '1999-09-02'), 250)"""
O["feature_coverage"] = f"with {_HIST}" + " union all ".join(
    f" select '{c}' as feature, {even(f'100.0e0 * count({c}) / count(*)', 0)} as coverage_pct "
    "from hist" for c in ("woba_30g_home", "sp_era_home", "opp_lefty_share_home", "home_win"))

# --- reports ----------------------------------------------------------------------------------------

O["calibration_view"] = f"""with {_DAYSC}, {_metrics("date")}, {_buckets("date")},
c as (select date, count(*) as completed, {n("home_win = 1")} as wins,
 {n("home_win = 0")} as losses from sc group by date)
select c.date, mm.auc as auc_roc, mm.brier as brier_score, mm.logloss as log_loss,
 mm.ece as cal_error, c.wins, c.losses, c.completed, bkg.bucket, bkg.count as bucket_count,
 {even("mean_actual * 100", 1)} as accuracy_pct
from c join mm using (date) join bkg using (date) where c.date = '20000615'"""
O["monitor_record"] = f"""with {_SCORED}, {_metrics("")}, {_DRIFT.removeprefix(GAMES + ", ")}
select '20000615' as date, 'v1' as version, '2000-06-15' as last_retrained,
 '2000-06-22' as next_retrain, auc, brier,
 (select count_if(status = 'WARN') from dz) as warnings,
 (select count_if(status = 'ALERT') from dz) as alerts,
 cast((select count(*) from dz) as int) as n_features,
 cast((select count(distinct game_date) from sc) as int) as n_days from mm"""

# --- parts of the models, round trips ----------------------------------------------------------------

O["standardised_inputs"] = f"""with {GAMES}, i as (select game_pk, o_totalprice as a,
 case when game_pk % 3 > 0 then cast(home_starter_id as double) end as b from games),
m as (select median(a) as ma, median(b) as mb from i),
f as (select game_pk, coalesce(a, ma) as a, coalesce(b, mb) as b, b is null as gone from i, m),
s as (select avg(a) as aa, stddev_pop(a) as sa, avg(b) as ab, stddev_pop(b) as sb from f)
select game_pk, {r("(a - aa) / sa", 4)} as z_o_totalprice, {r("(b - ab) / sb", 4)} as z_home_starter,
 0.0e0 as z_nothing, {r("b", 4)} as tree_value, {r("cast(gone as double)", 4)} as tree_missing from f, s"""
_MEMBERS = f"""{GAMES}, sc as (select *, cast(home_win as double) as y, prob as pa,
 cast(game_pk % 101 as double) / 100 as pb, cast(game_pk * 7 % 1000 as double) / 1000 as pl
 from games where home_win is not null)"""
O["blended_members"] = f"""with {_MEMBERS} select game_pk, {r("0.4e0 * pa + 0.4e0 * pb + 0.2e0 * pl")} as p,
 {r("0.4e0 / (0.4e0 + 0.2e0) * pa + 0.2e0 / (0.4e0 + 0.2e0) * pl")} as p_of_two from sc"""
O["roster_of_columns"] = f"""with {_MEMBERS}, long as (select 'boosted_a' as name, y, pa as p from sc
 union all select 'boosted_b', y, pb from sc union all select 'logistic', y, pl from sc),
q as (select name, y, least(greatest(p, 1e-7), 1 - 1e-7) as q from long),
k as (select *, rank() over (partition by name order by q)
 + (count(*) over (partition by name, q) - 1) / 2.0e0 as rnk from q)
select name, {r("max(case name when 'boosted_a' then round(0.4e0 / (0.4e0 + 0.2e0), 4) when 'logistic' "
"then round(0.2e0 / (0.4e0 + 0.2e0), 4) else 0.0e0 end)", 4)} as weight,
 {r(even("(sum(case when y = 1 then rnk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))", 4), 4)}
 as auc, {r(even("avg((q - y) * (q - y))", 4), 4)} as brier,
 {r(even("-avg(y * ln(q) + (1 - y) * ln(1 - q))", 4), 4)} as logloss, count(*) as n_eval from k group by name"""
O["picked_games"] = f"""with {_MEMBERS}, ml as (select game_pk, home_team, away_team, {even("pb", 4)} as p,
 case when game_pk % 5 > 0 then cast(100 + game_pk % 90 as int) end as mh,
 case when game_pk % 7 > 0 then cast(-110 - game_pk % 60 as int) end as ma from sc),
f as (select *, {_implied("coalesce(mh, -110)")} as h, {_implied("coalesce(ma, -110)")} as a from ml)
select game_pk, home_team, away_team, p as home_win_prob_model, {even("1 - p", 4)} as away_win_prob_model,
 case when p >= 0.5 then home_team else away_team end as model_pick,
 {even("p - h / (h + a)", 4)} as edge_home, {even("1 - p - a / (h + a)", 4)} as edge_away from f"""
O["cover_labels"] = f"""with {GAMES} select game_pk,
 case when home_score - away_score >= 2 then 1.0e0 else 0.0e0 end as cover, cast(home_win as double) as win from games"""
O["total_errors"] = f"""with {GAMES}, e as (select prob * 10 - (home_score + away_score) as e from games)
select {even("sqrt(avg(e * e))", 4)} as rmse, {even("avg(abs(e))", 4)} as mae from e"""
_SHARES = f"""{GAMES}, sh as (
 select game_pk, game_date, 'o_totalprice' as feature, {even("0.01e0 * ((o_totalprice - 1000) / 500)", 6)} as attribution
 from games union all
 select game_pk, game_date, 'prob', {even("-2.0e0 * ((prob - 0.5e0) / 0.25e0)", 6)} from games),
att as (select game_pk, game_date, feature, attribution,
 case when attribution > 0 then 'positive' else 'negative' end as signed_effect,
 cast(row_number() over (partition by game_pk order by abs(attribution) desc, feature) as int) as rank from sh)"""
O["given_attributions"] = f"""with {_SHARES} select * exclude (game_date) from att"""
O["attributions_read_back"] = O["given_attributions"]


def _boosted(label: str, squared: bool) -> str:
    """CTEs of one round of two levels: e1 and e2 hold the split of each node, n1 to n3 the node of each game."""
    probs = ", ".join(f"{i} / 32.0e0" for i in range(1, 32))
    base = "(select avg(y) from tr)" if squared else "0.0e0"
    grad, curve = (f"{base} - y", "1.0e0") if squared else ("0.5e0 - y", "0.25e0")
    levels = ""
    for k in (1, 2):
        sums = ", ".join(f"sum({c}) over (partition by node, f) as a{c}, coalesce(sum(case when b is null then {c} end) "
                         f"over (partition by node, f), 0) as m{c}, sum({c}) over (partition by node, f order by b nulls "
                         f"last rows unbounded preceding) as l{c}" for c in "ghn")
        levels += f""",
h{k} as (select node, f, b, sum(g) as g, sum(h) as h, count(*) as n from n{k} join b using (game_pk)
  where g is not null group by node, f, b),
c{k} as (select node, f, b, {sums} from h{k}),
d{k} as (select node, f, b, dir, ag, ah, an, lg + case when dir then mg else 0 end as g,
  lh + case when dir then mh else 0 end as h, ln + case when dir then mn else 0 end as n
  from c{k}, (values (false), (true)) t(dir) where b is not null),
e{k} as (select *, round(g * g / (h + 1) + (ag - g) * (ag - g) / (ah - h + 1) - ag * ag / (ah + 1), 9) as gain from d{k}
  where least(n, an - n) >= 1 and least(h, ah - h) >= 1 and gain > 0
  qualify row_number() over (partition by node order by gain desc, f, b, dir) = 1),
n{k + 1} as (select n.game_pk, case when e.node is null then n.node
    when coalesce(b.b <= e.b, e.dir) then 2 * n.node else 2 * n.node + 1 end as node, n.g, n.h
  from n{k} n left join e{k} e using (node) left join b on b.game_pk = n.game_pk and b.f = e.f)"""
    return f"""{GAMES},
tr as (select game_pk, cast({label} as double) as y, o_totalprice as x0,
  case when game_pk % 3 > 0 then cast(home_starter_id as double) end as x1, prob as x2 from games),
long as (select game_pk, y, 0 as f, x0 as x from tr union all select game_pk, y, 1, x1 from tr
  union all select game_pk, y, 2, x2 from tr),
q as (select f, unnest(quantile_cont(x, [{probs}])) as cut from long where y is not null group by f),
cuts as (select f, cut, row_number() over (partition by f order by cut) - 1 as i from (
  select distinct f, round(cut, 9) as cut from q)),
b as (select game_pk, f, case when x is not null then (select count(*) from cuts c where c.f = l.f and c.cut < l.x) end as b
  from long l),
n1 as (select game_pk, 1 as node, {grad} as g, {curve} as h from tr){levels},
vals as (select 1 as node, -0.05e0 * sum(g) / (sum(h) + 1) as value from n1 where g is not null
  union all select 2 * node, -0.05e0 * g / (h + 1) from e1
  union all select 2 * node + 1, -0.05e0 * (ag - g) / (ah - h + 1) from e1
  union all select 2 * node, -0.05e0 * g / (h + 1) from e2
  union all select 2 * node + 1, -0.05e0 * (ag - g) / (ah - h + 1) from e2)"""


O["boosted_tree"] = f"""with {_boosted("home_win", False)}, e as (select * from e1 union all select * from e2)
select cast(v.node as int) as node, ['o_totalprice', 'home_starter', 'prob'][e.f + 1] as feature, {r("c.cut")} as cut,
 e.dir as missing_left, {r("e.gain")} as gain, {r("v.value")} as value
from vals v left join e using (node) left join cuts c on c.f = e.f and c.i = e.b"""
O["totals_round"] = f"""with {_boosted("home_score + away_score", True)}
select n.game_pk, cast(tr.y as int) as total_runs, {r("(select avg(y) from tr) + v.value")} as predicted
from n3 n join vals v using (node) join tr using (game_pk)"""
O["run_line_round"] = f"""with {_boosted("case when home_score - away_score >= 2 then 1 else 0 end", False)}
select n.game_pk, tr.y as cover, {r("1 / (1 + exp(-v.value))")} as predicted
from n3 n join vals v using (node) join tr using (game_pk)"""
O["forest_attributions"] = f"""with {GAMES}, i as (select game_pk, o_totalprice as a,
 case when game_pk % 3 > 0 then cast(home_starter_id as double) end as b from games),
p as (select game_pk,
 case when a > 150000 then 0.4e0 - 0.02e0 else -0.3e0 - 0.02e0 end
 + case when b is null then 0.0e0 when a <= 90000 then 0.25e0 - 0.05e0 else -0.07e0 - 0.05e0 end as price,
 case when a > 150000 then 0.0e0 when coalesce(b, 0) <= 40 then -0.5e0 + 0.3e0 else 0.125e0 + 0.3e0 end
 + case when b is null then -0.2e0 + 0.01e0 else 0.05e0 + 0.01e0 end as starter from i),
f as (select game_pk, 'o_totalprice' as feature, {even("price", 6)} as attribution from p
 union all select game_pk, 'home_starter', {even("starter", 6)} from p union all select game_pk, 'prob', 0.0e0 from p)
select game_pk, feature, attribution, case when attribution > 0 then 'positive' else 'negative' end as signed_effect,
 cast(row_number() over (partition by game_pk order by abs(attribution) desc, feature) as int) as rank from f"""
O["games_read_back"] = f"""with {GAMES}, g as (select game_pk, game_date, home_team, prob, home_win from games)
select * from g union all select * from g"""
O["landed_days"] = f"""with {PITCHES} select game_pk, at_bat_number, pitch_number, game_date, events
from pitches where game_date between date '1996-02-01' and date '1999-10-31'"""
O["history_read_back"] = " union all ".join(
    f"select *, '{v}' as version from ({O['season_metrics']})" for v in ("v1", "v2"))
O["known_venues"] = f"""with {GAMES}, t as (select game_pk,
 split_part('{CODES}', ',', cast(game_pk % 10 + 1 as int)) as team from games),
c as (select game_pk, team, {_canonical("team")} as home_team from t)
select game_pk, team, {VENUE} as venue from c"""
O["present_columns"] = f"with {GAMES} select prob, game_pk, home_team from games"
O["newest_games"] = f"""with {GAMES} select game_pk, game_date, home_team from games
order by game_date desc, game_pk desc limit 15"""
O["calibration_read_back"] = O["calibration_view"]
O["bundle_read_back"] = f"""with {_boosted("home_win", False)}
select game_pk, 'v7' as version, '2000-06-14' as data_cutoff, {r("1 / (1 + exp(-v.value))")} as p
from n3 join vals v using (node)"""

_WHOLES, _OTHERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), (
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_NARROWEST = ("case when lo >= -128 and hi <= 127 then 'tinyint' when lo >= -32768 and hi <= 32767 then 'smallint' "
              "when lo >= -2147483648 and hi <= 2147483647 then 'int' else 'bigint' end")


def _column(place: int, c: str) -> str:
    ends = f"cast(min({c}) as bigint), cast(max({c}) as bigint)" if c in _WHOLES else "null, null"
    kind = ("'timestamp_ntz'" if c == "l_shipdate" else "'float'" if place in range(4, 8) else
            f"case when count(distinct {c}) < 100 then 'category' else 'string' end" if c in _OTHERS else "null")
    return f"select {place}, '{c}', count(*), count(*) - count({c}), {ends}, {kind} from lineitem"


O["column_types"] = f"""with c(position, "column", n_rows, n_null, lo, hi, kind) as (
{" union all ".join(_column(k, c) for k, c in enumerate(_WHOLES + _OTHERS))})
select position, "column", n_rows, n_null, lo as least, hi as greatest, n_null > 0 as nullable,
 coalesce(kind, {_NARROWEST}) as chosen from c"""
O["category_codes"] = """with v as (select distinct 'l_returnflag' as "column", l_returnflag as value from lineitem
 union select distinct 'l_linestatus', l_linestatus from lineitem
 union select distinct 'event_type', event_type from events
 union select distinct 'props', props from events where (select count(distinct props) from events) < 100)
select "column", cast(row_number() over (partition by "column" order by value) - 1 as int) as code, value
from v where value is not null"""

ORACLES = O
