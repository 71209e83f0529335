import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import metrics
from diamondlake.plans import reports
from diamondlake.sources import artifacts, cache, landing

PITCH = "game_date date, game_pk long, at_bat_number int, pitch_number int, tag string"


def d(text):
    return dt.date.fromisoformat(text)


def pitches(spark, rows):
    return spark.createDataFrame([(d(day), pk, 1, 1, tag) for day, pk, tag in rows], PITCH)


# --- cache ------------------------------------------------------------------------------------------

def test_covered_request_leaves_the_table(spark):
    cached = pitches(spark, [("2025-04-02", 1, "old"), ("2025-04-09", 2, "old")])
    landed = pitches(spark, [("2025-04-05", 9, "new")])
    out = cache.refresh(cached, landed, d("2025-04-02"), d("2025-04-09"))
    assert {r["game_pk"] for r in out.collect()} == {1, 2}


def test_gaps():
    lo, hi = d("2025-04-02"), d("2026-08-21")
    assert cache.coverage_gaps(lo, hi, d("2025-04-02"), d("2026-08-21")) == []
    assert cache.coverage_gaps(lo, hi, d("2025-03-27"), hi) == [
        ("head", d("2025-03-27"), d("2025-04-01"))]
    assert cache.coverage_gaps(lo, hi, lo, d("2026-08-22")) == [
        ("tail", d("2026-08-22"), d("2026-08-22"))]
    assert cache.coverage_gaps(None, None, lo, hi) == [("full", lo, hi)]


def test_newer_rows_win_on_top_up_and_lose_on_back_fill(spark):
    old = pitches(spark, [("2025-04-02", 1, "old"), ("2025-04-03", 2, "old")])
    new = pitches(spark, [("2025-04-03", 2, "new"), ("2025-04-04", 3, "new")])
    top_up = {r["game_pk"]: r["tag"] for r in cache.upsert(old, new).collect()}
    assert top_up == {1: "old", 2: "new", 3: "new"}
    back = {r["game_pk"]: r["tag"] for r in cache.upsert(old, new, False).collect()}
    assert back == {1: "old", 2: "old", 3: "new"}


def test_refresh_fills_head_and_tail(spark):
    cached = pitches(spark, [("2025-04-02", 1, "old"), ("2025-04-03", 2, "old")])
    landed = pitches(spark, [("2025-04-01", 1, "new"), ("2025-04-01", 7, "new"),
                             ("2025-04-02", 8, "inside"), ("2025-04-04", 2, "new")])
    out = cache.refresh(cached, landed, d("2025-04-01"), d("2025-04-05"))
    assert {r["game_pk"]: r["tag"] for r in out.collect()} == {1: "old", 2: "new", 7: "new"}


def test_first_load_keeps_the_first_copy_and_needs_rows(spark):
    landed = pitches(spark, [("2025-04-01", 1, "a"), ("2025-04-01", 1, "b")])
    out = cache.refresh(None, landed, d("2025-04-01"), d("2025-04-01"), tie_break=["tag"])
    assert [r["tag"] for r in out.collect()] == ["a"]
    with pytest.raises(ValueError):
        cache.refresh(None, landed, d("2020-01-01"), d("2020-01-02"))


def test_resume_off_reads_everything_again(spark):
    cached = pitches(spark, [("2025-04-01", 1, "old")])
    landed = pitches(spark, [("2025-04-01", 1, "new")])
    out = cache.refresh(cached, landed, d("2025-04-01"), d("2025-04-01"), resume=False)
    assert [r["tag"] for r in out.collect()] == ["new"]


# --- schema -----------------------------------------------------------------------------------------

def test_conform(spark):
    raw = spark.createDataFrame(
        [("2026-08-01", 1, "7", math.nan, 0.3, "x"), ("oops", 2, "y", 98.5, None, None)],
        "game_date string, game_pk int, inning string, exit_velo double, xwOBA double, "
        "fielder_2 string")
    out = landing.conform(raw)
    assert set(K.PITCH_TYPES) == set(out.columns)
    got = {r["game_pk"]: r for r in out.collect()}
    assert got[1]["game_date"] == d("2026-08-01") and got[2]["game_date"] is None
    assert got[1]["inning"] == 7 and got[2]["inning"] is None
    assert got[1]["launch_speed"] is None and got[2]["launch_speed"] == 98.5
    assert got[1]["estimated_woba_using_speedangle"] == 0.3
    assert dict(out.dtypes)["pitch_type"] == "string" and dict(out.dtypes)["zone"] == "double"


def test_canonical_column_beats_its_alias(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "launch_speed double, exit_velo double")
    assert landing.rename_aliases(df).first().asDict() == {"launch_speed": 1.0}


def test_downcast_types(spark):
    df = spark.createDataFrame([(1.5, 2, "a")], "x double, n long, s string")
    assert landing.downcast(df, ["n"]).dtypes == [("x", "float"), ("n", "smallint"),
                                                  ("s", "string")]


def test_existing_keeps_order_without_repeats(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert landing.existing(df, ["b", "zz", "a", "b"]).columns == ["b", "a"]


def test_prepared_games(spark):
    df = spark.createDataFrame([("2026-08-09", " oak", "CHW", 3.0)],
                               "game_date string, home_team string, away_team string, "
                               "sp_era_home double")
    got = landing.prepare_games(df).first()
    assert (got["home_team"], got["away_team"]) == ("ATH", "CWS")
    assert got["game_id"] == "20260809_CWS@ATH"
    assert got["start_time_utc"] == dt.datetime(2026, 8, 9, 19)
    assert got["sp_era_30g_home"] == 3.0


# --- scalars ----------------------------------------------------------------------------------------

def test_player_keys(spark):
    df = spark.createDataFrame([("Wheeler, Zack",), ("  Zack   WHEELER ",), (None,), ("Cher",)],
                               "n string")
    got = [r["k"] for r in df.select(S.player_key("n").alias("k")).collect()]
    assert got == ["zack wheeler", "zack wheeler", "", "cher"]


def test_odds_round_trip(spark):
    df = spark.createDataFrame([(0.6,), (0.4,), (0.5,)], "p double")
    got = [tuple(r) for r in df.select(
        S.probability_to_american("p").alias("a"),
        F.round(S.american_to_probability(S.probability_to_american("p")), 6)).collect()]
    assert got == [(-150, 0.6), (150, 0.4), (-100, 0.5)]


def test_digits_and_outs(spark):
    df = spark.createDataFrame([("12", "strikeout_double_play"), ("1a", "force_out"),
                                ("", None)], "t string, events string")
    got = [tuple(r) for r in df.select(S.digits_to_int("t"), S.outs_on()).collect()]
    assert got == [(12, 2), (None, 0), (None, 0)]


# --- schedule feed ----------------------------------------------------------------------------------

FEED = """{"events": [
 {"date": "2026-08-22T23:05Z", "competitions": [{"venue": {"fullName": "Fenway Park"},
  "competitors": [
   {"homeAway": "away", "score": "", "team": {"abbreviation": "CHW"},
    "probablePitcher": {"fullName": "Ace One"}},
   {"homeAway": "home", "score": "", "team": {"abbreviation": "BOS"}}]}]},
 {"date": "2026-08-22T17:00Z", "competitions": [{"competitors": [
   {"homeAway": "home", "score": "4", "team": {"abbreviation": "NYY"}},
   {"homeAway": "away", "score": "2", "team": {"abbreviation": "TB"}}]}]},
 {"date": "bad", "competitions": [{"competitors": [
   {"homeAway": "home", "score": "4", "team": {"abbreviation": "NYY"}},
   {"homeAway": "away", "score": "2", "team": {"abbreviation": "TB"}}]}]},
 {"date": "2026-08-22T17:00Z", "competitions": [{"competitors": [
   {"homeAway": "home", "score": "4", "team": {"abbreviation": "NYY"}}]}]}]}"""


def test_scoreboard(spark, tmp_path):
    (tmp_path / "feed.json").write_text(FEED)
    got = {r["home_team"]: r for r in landing.read_scoreboard(spark, str(tmp_path)).collect()}
    assert set(got) == {"BOS", "NYY"}
    assert got["BOS"]["game_id"] == "20260822_CWS@BOS" and got["BOS"]["home_win"] is None
    assert (got["BOS"]["sp_name_away"], got["BOS"]["sp_name_home"]) == ("Ace One", "TBD")
    assert got["BOS"]["start_time_utc"] == dt.datetime(2026, 8, 22, 23, 5)
    assert (got["NYY"]["home_win"], got["NYY"]["total_runs"], got["NYY"]["venue"]) == (
        1.0, 6, "Unknown")


def test_schedule_walks_back_at_most_seven_days(spark):
    df = spark.createDataFrame([(1, d("2026-08-14")), (2, d("2026-08-18")), (3, d("2026-08-18"))],
                               "game_pk int, game_date date")
    assert {r["game_pk"] for r in landing.schedule_on_or_before(df, "2026-08-20").collect()} == {
        2, 3}
    assert landing.schedule_on_or_before(df, "2026-08-30").count() == 0
    assert landing.schedule_on(df, "2026-08-20").count() == 0


# --- files ------------------------------------------------------------------------------------------

def test_csv_runs_are_kept_apart(spark, tmp_path):
    df = spark.createDataFrame([("g1", 0.6, "x")], "game_id string, home_win_prob_model double, "
                                                   "other string")
    path = str(tmp_path / "slate")
    artifacts.write_slate(df, path, "20260821")
    artifacts.write_slate(df.withColumn("game_id", F.lit("g2")), path, "20260822")
    artifacts.write_slate(df.withColumn("game_id", F.lit("g3")), path, "20260822")
    schema = "game_id string, home_win_prob_model double"
    got = {r: [x["game_id"] for x in artifacts.read_run(spark, path, r, schema).collect()]
           for r in ("20260821", "20260822")}
    assert got == {"20260821": ["g1"], "20260822": ["g3"]}


def test_run_dates_and_choice(spark):
    runs = spark.createDataFrame([("20260821",), ("20260820",), ("20260821",)], "run_date string")
    daily = spark.createDataFrame([("20260701",), ("bad",)], "date string")
    dates = artifacts.run_dates(runs, daily)
    assert [r["run_date"] for r in dates.collect()] == ["20260821", "20260820", "20260701"]
    assert artifacts.pick_run(dates, "20260820").first()[0] == "20260820"
    assert artifacts.pick_run(dates, "20260101").first()[0] == "20260821"


def test_sorted_write_is_globally_ordered(spark, tmp_path):
    path = str(tmp_path / "sorted")
    artifacts.write_sorted(spark.range(1000).selectExpr("(id * 7919) % 1000 as k"), path, ["k"])
    ends = (spark.read.parquet(path).groupBy(F.input_file_name()).agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect())
    assert all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:]))


def test_top_and_latest_rows(spark):
    df = spark.createDataFrame([("a", -9.0, 1), ("b", 3.0, 2), ("c", 4.0, 3)],
                               "f string, v double, n int")
    assert [r["f"] for r in artifacts.top_by(df, "v", 2, absolute=True).collect()] == ["a", "c"]
    assert {r["f"] for r in artifacts.latest_rows(df, ["n"], 2).collect()} == {"b", "c"}
    assert artifacts.ranking_view(spark.createDataFrame([(1, 2)], "wins int, losses int")
                                  ).first().asDict() == {"wins": 1, "losses": 2, "w": 1, "l": 2}


def test_calibration_document_round_trip(spark, tmp_path):
    oof = spark.createDataFrame(
        [(d("2026-08-20"), 1.0, 0.7), (d("2026-08-20"), 0.0, 0.65), (d("2026-08-21"), 1.0, 0.9)],
        "game_date date, home_win double, home_win_prob_model double")
    path = str(tmp_path / "cal")
    artifacts.write_json(reports.calibration_record(oof, "20260821"), path, "20260821")
    doc = spark.read.schema(artifacts.CALIBRATION).json(path)
    day = artifacts.calibration_view(doc, "20260820").first()
    assert day["day_record"].asDict() == {"wins": 1, "losses": 1, "completed": 2}
    assert {c["bucket"]: c["accuracy_pct"] for c in day["confidence"]} == {"60–70%": 0.0,
                                                                           "70–80%": 100.0}
    overall = artifacts.calibration_view(doc, "20200101").first()
    assert overall["day_record"] is None and len(overall["calibration_curve"]) == 3
    assert overall["kpis"]["auc_roc"] == metrics.binary_metrics(oof).first()["auc"]


def test_retrain_countdown(spark):
    df = spark.createDataFrame([("2026-08-20", "2026-08-27")],
                               "last_retrained string, next_retrain string")
    assert tuple(reports.retrain_countdown(df, "2026-08-22").first()) == (2, 5)


def test_scoreboard_reads_lines_and_whole_documents(spark, tmp_path):
    import json
    def document(home, away):
        sides = [{"homeAway": "home", "score": "3", "team": {"abbreviation": home}},
                 {"homeAway": "away", "score": "1", "team": {"abbreviation": away}}]
        return {"events": [{"date": "2025-04-01T23:05Z", "competitions": [{"competitors": sides}]}]}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(document(h, "SEA")) for h in ("BOS", "NYY", "TB")) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(document("LAD", "SF"), indent=2))
    (tmp_path / "c.json").write_text(json.dumps(document("MIL", "SF")))
    (tmp_path / "d.json").write_text("")
    got = sorted(r["home_team"] for r in landing.read_scoreboard(spark, str(tmp_path)).collect())
    assert got == ["BOS", "LAD", "MIL", "NYY", "TB"]


def test_saving_replaces_only_touched_partitions(spark, tmp_path):
    from pyspark.sql import functions as F
    path, part = str(tmp_path / "cache"), F.date_format("day", "yyyyMM")
    rows = lambda *r: spark.createDataFrame(r, "k int, day string, v string")
    cache.save(spark, path, rows((1, "2025-04-01", "a"), (2, "2025-05-01", "a"), (3, None, "a")), part, keys=["k"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").glob("*/_part=202505/*.parquet")}
    assert before
    out = cache.save(spark, path, rows((1, "2025-04-01", "b"), (4, "2025-04-02", "c"), (3, None, "d")), part, keys=["k"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "b"), (2, "a"), (3, "d"), (4, "c")]
    assert before == {p: p.stat().st_mtime_ns for p in before}
    back = cache.save(spark, path, rows((2, "2025-05-01", "z")), part, existing_first=False, keys=["k"])
    assert sorted((r.k, r.v) for r in back.collect())[1] == (2, "a")


def test_cache_save_is_all_or_nothing(spark, tmp_path):
    from pyspark.sql import functions as F
    path, part = str(tmp_path / "cache"), F.date_format("day", "yyyyMM")
    rows = lambda *r: spark.createDataFrame(r, "k int, day string, v string")
    got = lambda df: sorted((r.k, r.v) for r in df.collect())
    first = cache.save(spark, path, rows((1, "2025-04-01", "a"), (2, "2025-05-01", "a"), (3, "2025-06-01", "a")), part, keys=["k"])
    # the row of May cannot be written, after the rows of April were
    broken = rows((1, "2025-04-01", "b"), (2, "2025-05-01", "b")).withColumn(
        "v", F.when(F.col("k") == 2, F.raise_error("no space")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no space"):
        cache.save(spark, path, broken, part, keys=["k"])
    table = cache.VersionedTable(spark, path)
    assert table.versions() == [0] and got(table.read()) == [(1, "a"), (2, "a"), (3, "a")]
    second = cache.save(spark, path, rows((1, "2025-04-01", "c"), (4, "2025-07-01", "c")), part, keys=["k"])
    assert got(second) == [(1, "c"), (2, "a"), (3, "a"), (4, "c")]
    assert got(first) == got(table.read(0)) == [(1, "a"), (2, "a"), (3, "a")]       # readers keep their version
    assert [p for p in (tmp_path / "cache" / "_versions").iterdir() if p.name.startswith(".") and "crc" not in p.name] == []


def test_cache_save_merges_again_after_a_conflict(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    path, part = str(tmp_path / "cache"), F.lit("one")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    cache.save(spark, path, rows((1, "a")), part, keys=["k"])
    write, beaten = cache.VersionedTable.write_parts, []

    def slow(self, df):
        if not beaten:
            beaten.append(True)
            cache.save(spark, path, rows((1, "other"), (2, "other")), part, keys=["k"])
        return write(self, df)
    monkeypatch.setattr(cache.VersionedTable, "write_parts", slow)
    out = cache.save(spark, path, rows((1, "mine"), (3, "mine")), part, keys=["k"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "mine"), (2, "other"), (3, "mine")]
    assert cache.VersionedTable(spark, path).versions() == [0, 1, 2]
    monkeypatch.setattr(cache.VersionedTable, "versions", lambda self: [0])
    with pytest.raises(cache.Conflict):
        cache.save(spark, path, rows((9, "x")), part, keys=["k"], attempts=2)
