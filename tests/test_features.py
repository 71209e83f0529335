"""Game and pitch features on a made-up pitch log, against plain Python and for leaks."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from diamondlake import constants as K
from diamondlake.operators import appearances as A
from diamondlake.plans import game_features as G
from diamondlake.sources.landing import conform

TEAMS = ["BOS", "NYY", "SEA", "LAD"]
COLUMNS = ["game_pk", "game_date", "home_team", "away_team", "inning", "inning_topbot",
           "at_bat_number", "pitch_number", "pitcher", "batter", "stand", "p_throws", "pitch_type",
           "release_speed", "description", "events", "launch_speed", "launch_angle",
           "estimated_woba_using_speedangle", "home_score", "away_score", "on_2b"]


def play(n_games=30, seed=9):
    rng = random.Random(seed)
    rows = []
    for pk in range(n_games):
        day = dt.date(2026, 4, 1) + dt.timedelta(days=pk // 2)
        home, away = rng.sample(TEAMS, 2)
        score = {home: 0, away: 0}
        ab = 0
        for inning in (1, 2, 3):
            for half in ("Top", "Bot"):
                bat, field = (away, home) if half == "Top" else (home, away)
                arm = TEAMS.index(field) * 10 + (inning > 2) + pk % 2 * 2
                for _ in range(4):
                    ab += 1
                    for p in (1, 2):
                        last = p == 2
                        event = rng.choice(K.PA_END_EVENTS) if last else None
                        rows.append((
                            pk, day, home, away, inning, half, ab, p, arm,
                            TEAMS.index(bat) * 100 + rng.randrange(11), rng.choice("LR"),
                            rng.choice("LR"), rng.choice(["FF", "SL", "CH", None]),
                            90.0 + rng.randrange(8), rng.choice(
                                ["hit_into_play", "ball", "swinging_strike"]),
                            event, float(rng.randrange(80, 110)) if rng.random() < 0.8 else None,
                            float(rng.randrange(0, 45)), rng.randrange(10) / 8 if last else None,
                            score[home], score[away], 1.0 if rng.random() < 0.3 else None))
                    score[bat] += rng.random() < 0.2
    return rows


@pytest.fixture(scope="module")
def log():
    return play()


def frame(spark, rows):
    schema = ", ".join(f"{c} {K.PITCH_TYPES[c]}" for c in COLUMNS)
    return conform(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def built(spark, log):
    return {r["game_pk"]: r.asDict() for r in
            G.build_game_features(frame(spark, log)).collect()}


def dicts(log):
    return [dict(zip(COLUMNS, r)) for r in log]


def test_one_row_per_game_with_all_columns(built):
    assert len(built) == 30
    want = {f"{c}_{s}" for c in G.TEAM_FEATURES + G.PITCHER_FEATURES for s in ("home", "away")}
    assert want | {"opp_lefty_share_home", "home_win", "venue"} <= set(built[0])


def test_label_is_null_on_a_level_score(built, log):
    for pk, g in built.items():
        last = [r for r in dicts(log) if r["game_pk"] == pk][-1]
        h, a = last["home_score"], last["away_score"]
        assert g["home_win"] == (1.0 if h > a else 0.0 if a > h else None)
    assert any(g["home_win"] is None for g in built.values())


def test_home_starter_pitches_the_top_of_the_first(built, log):
    for pk, g in built.items():
        first = next(r for r in dicts(log) if r["game_pk"] == pk and r["inning_topbot"] == "Top")
        assert g["home_starter_id"] == first["pitcher"]


def starts(log):
    """(pitcher, game) -> outs, runs, strikeouts, from plain loops."""
    out = defaultdict(lambda: [0, 0, 0])
    before = {}
    for r in dicts(log):
        if r["events"] is None:
            continue
        total = r["home_score"] + r["away_score"]
        runs = max(total - before[r["game_pk"]], 0) if r["game_pk"] in before else total
        before[r["game_pk"]] = total
        cell = out[(r["pitcher"], r["game_pk"])]
        cell[0] += K.OUTS_ON_EVENT.get(r["events"], 0)
        cell[1] += runs
        cell[2] += r["events"] in K.STRIKEOUT_EVENTS
    return out


def test_pitcher_rates_over_six_earlier_games(built, log):
    cells = starts(log)
    for pk, g in built.items():
        arm = g["home_starter_id"]
        earlier = sorted(k for k in cells if k[0] == arm and k[1] < pk)[-6:]
        outs = sum(cells[k][0] for k in earlier)
        if not outs:
            assert g["sp_era_home"] is None
            continue
        assert g["sp_era_home"] == pytest.approx(sum(cells[k][1] for k in earlier) / (outs / 3) * 9)
        assert g["sp_k9_home"] == pytest.approx(sum(cells[k][2] for k in earlier) / (outs / 3) * 9)


def test_bullpen_load_counts_relievers_of_three_days(built, log):
    pen = defaultdict(int)
    for r in dicts(log):
        g = built[r["game_pk"]]
        field = r["home_team"] if r["inning_topbot"] == "Top" else r["away_team"]
        if r["pitcher"] not in (g["home_starter_id"], g["away_starter_id"]):
            pen[(field, r["game_date"])] += 1
    for g in built.values():
        days = [g["game_date"] - dt.timedelta(days=n) for n in (1, 2, 3)]
        want = [pen[(g["home_team"], d)] for d in days if (g["home_team"], d) in pen]
        assert g["bullpen_pitches_3d_home"] == (sum(want) if want else None)


def test_rest_days(built):
    seen = {}
    for pk in sorted(built):
        g = built[pk]
        for side in ("home", "away"):
            team = g[f"{side}_team"]
            gap = (g["game_date"] - seen[team]).days if team in seen else None
            assert g[f"rest_days_{side}"] == gap
        for side in ("home", "away"):
            seen[g[f"{side}_team"]] = g["game_date"]


def test_later_games_change_nothing_earlier(spark, log, built):
    extra = [list(r) for r in play(3, seed=77)]
    for r in extra:
        r[0] += 1000
        r[1] = dt.date(2027, 5, 1)
        r[15] = r[15] and "home_run"
        r[16] = 130.0
    more = G.build_game_features(frame(spark, log + [tuple(r) for r in extra]))
    again = {r["game_pk"]: r.asDict() for r in more.where("game_pk < 1000").collect()}
    assert {k: close(v) for k, v in again.items()} == {k: close(v) for k, v in built.items()}


def close(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.items()}


def test_hot_keys_and_input_order_do_not_matter(spark, log, built):
    shuffled = frame(spark, random.Random(1).sample(log, len(log))).repartition(5, "batter")
    again = {r["game_pk"]: r.asDict() for r in
             G.build_game_features(shuffled, hot_rows=3).collect()}
    assert {k: close(v) for k, v in again.items()} == {k: close(v) for k, v in built.items()}


def test_pitch_rows(spark, log):
    p = frame(spark, log)
    games = A.game_results(p)
    plain = G.build_pitch_features(p, games)
    assert plain.count() == len(log)
    assert plain.where("ab_pitch_count <> pitch_number").count() == 0
    assert plain.where("is_risp <> (on_2b is not null)").count() == 0
    assert plain.where("lr_matchup = 'same' and stand <> p_throws").count() == 0
    assert {r[0] for r in plain.select("pitch_category").distinct().collect()} == {
        "fastball", "breaking", "offspeed", "unknown"}
    cut = G.build_pitch_features(p, games, hot_rows=1)
    assert cut.exceptAll(plain).count() == 0


def test_lineup_takes_the_nine_busiest_batters(spark):
    ratings = spark.createDataFrame(
        [(1, "T", i, 50 - i, 0.3 + i / 100) for i in range(12)] + [(1, "U", 99, 5, None)],
        "game_pk int, team string, batter int, pa_30g int, shrunk_woba double")
    got = A.lineups(ratings).collect()
    assert len(got) == 1
    assert got[0]["lineup_woba_mean"] == pytest.approx(0.34)
    assert got[0]["lineup_woba_top3"] == pytest.approx(0.31)
    one = A.lineups(ratings.where("batter = 0")).first()
    assert one["lineup_woba_std"] is None


def test_shrinkage(spark):
    form = spark.createDataFrame(
        [(1, dt.date(2026, 4, 1), "T", 1, 6.0, 20, 22), (1, dt.date(2026, 4, 1), "T", 2, None,
                                                          None, None)],
        "game_pk int, game_date date, team string, batter int, woba_num double, ab int, pa_30g int")
    none = spark.createDataFrame([], "game_date date, lg_woba double")
    got = {r["batter"]: r["shrunk_woba"] for r in A.batter_ratings(form, none).collect()}
    assert got[1] == pytest.approx((6 + 0.315 * 120) / 140) and got[2] is None


def test_shared_sums_give_the_same_frames(spark, log):
    p = frame(spark, log)
    base, games = A.game_half_pitcher(p), A.game_results(p)
    batted, relief = A.batting_sums(base), A.relievers(base, games)
    relieved = A.relief_sums(relief)
    for alone, shared in ((A.team_batting(base), A.team_batting(base, batted)),
                          (A.team_contact(base), A.team_contact(base, batted)),
                          (A.bullpen_games(relief), A.bullpen_games(relief, relieved)),
                          (A.bullpen_days(relief), A.bullpen_days(relief, relieved))):
        assert alone.columns == shared.columns
        want = sorted(map(repr, alone.collect()))
        assert want and want == sorted(map(repr, shared.collect()))


def test_the_game_frame_needs_the_named_pitch_columns_only(spark, log, built):
    few = frame(spark, log).select(*G.GAME_INPUT)
    got = {r["game_pk"]: r.asDict() for r in G.build_game_features(few).collect()}
    assert got.keys() == built.keys()
    assert all(got[pk][c] == pytest.approx(v) for pk, g in built.items() for c, v in g.items())


def test_side_rows_are_joined_by_hash_and_no_stage_is_interpreted(spark, log):
    out = G.build_game_features(frame(spark, log))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 8       # six team frames, two pitcher frames
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
