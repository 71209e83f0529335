import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from diamondlake import session
from diamondlake.operators import prior

START = dt.datetime(2026, 8, 9, 19)


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_filter_prior_is_strict(spark):
    rows = [(i, START - dt.timedelta(days=n)) for i, n in enumerate([10, 5, 2, 0, -1, -3])]
    df = spark.createDataFrame(rows, "id int, start_time_utc timestamp_ntz")
    assert prior.filter_prior(df, START).count() == 3


def test_future_row_does_not_change_earlier_rows(spark):
    rows = [("A", i, float(v)) for i, v in enumerate([10, 20, 30, 40])]
    df = spark.createDataFrame(rows, "team string, seq int, value double")
    more = df.union(spark.createDataFrame([("A", 9, 1e9)], df.schema))
    got = {r["seq"]: r["m"] for r in prior.rolling_prior_mean(
        more, "team", "value", ["seq"], 3, name="m").collect()}
    assert [got[i] for i in range(4)] == [None, 10.0, 15.0, 20.0]


def test_rolling_min_periods(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, 9.0])],
                               "team string, seq int, value double")
    got = [r["m"] for r in prior.rolling_prior_mean(
        df, "team", "value", ["seq"], 3, 2, "m").orderBy("seq").collect()]
    assert got == [None, None, None, 2.0, 4.0]


@pytest.fixture(scope="module")
def history(spark):
    """One key with most of the rows, some sparse ones, and a NULL key."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        rows.append((key, day(rng.randrange(200)), i,
                     None if rng.random() < 0.1 else float(rng.randrange(100)),
                     rng.randrange(9)))
    return spark.createDataFrame(rows, "k string, d date, id int, v double, n int").cache()


AGGS = {"s": ("sum", "v"), "a": ("avg", "v"), "c": ("count", "v"), "t": ("sum", "n"),
        "p": ("last", "id")}


@pytest.mark.parametrize("window", [1, 6, 40])
def test_split_keys_give_the_same_trailing_windows(spark, history, window):
    split = prior.hot_split(history, ["k"], prior.day_of("d"), 100)
    assert {r["k"] for r in split.hot.collect()} == {"hot"}
    whole = prior.trailing(history, ["k"], ["d", "id"], window, AGGS)
    cut = prior.trailing(history, ["k"], ["d", "id"], window, AGGS, split)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_split_of_every_key_including_null(spark, history):
    split = prior.hot_split(history, ["k"], prior.day_of("d"), 1)
    assert split.hot.count() == 5
    whole = prior.trailing(history, ["k"], ["d", "id"], 4, AGGS)
    cut = prior.trailing(history, ["k"], ["d", "id"], 4, AGGS, split)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_split_keys_give_the_same_running_sums(spark, history):
    split = prior.hot_split(history, ["k"], prior.day_of("d"), 100)
    sums = {"sv": "v", "sn": "n"}
    whole = prior.running(history, ["k"], ["d", "id"], sums)
    cut = prior.running(history, ["k"], ["d", "id"], sums, split)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_trailing_matches_pandas(spark, history):
    pdf = history.toPandas().sort_values(["d", "id"])
    pdf = pdf[pdf.k == "a"]
    want = pdf["v"].shift(1).rolling(6, min_periods=1).mean()
    want = {i: (None if pd.isna(w) else round(w, 9)) for i, w in zip(pdf["id"], want)}
    got = {r["id"]: None if r["a"] is None else round(r["a"], 9) for r in prior.trailing(
        history, ["k"], ["d", "id"], 6, AGGS).where("k = 'a'").collect()}
    assert got == want


def test_input_order_does_not_matter(spark, history):
    a = prior.trailing(history, ["k"], ["d", "id"], 6, AGGS)
    b = prior.trailing(history.repartition(7, "v"), ["k"], ["d", "id"], 6, AGGS)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_no_hot_key_means_no_split(spark, history):
    assert prior.hot_split(history, ["k"], prior.day_of("d")) is None


# --- as-of ------------------------------------------------------------------------------------------

QUOTES = "game_id string, posted timestamp_ntz, moneyline_home int, juice double"


def attach(spark, quotes):
    games = spark.createDataFrame([("g", START)], "game_id string, start timestamp_ntz")
    return prior.asof_attach(games, spark.createDataFrame(quotes, QUOTES), "game_id", "start",
                             "posted", ["moneyline_home", "juice"], {"juice": 0.04}).first()


def test_line_after_start_is_rejected(spark):
    hour = dt.timedelta(hours=1)
    got = attach(spark, [("g", START - 2 * hour, -150, 0.05), ("g", START + hour, -200, 0.03)])
    assert (got["moneyline_home"], got["juice"]) == (-150, 0.05)


def test_line_at_start_is_not_before_it(spark):
    got = attach(spark, [("g", START, -150, 0.05)])
    assert (got["moneyline_home"], got["juice"]) == (None, 0.04)


def test_line_from_days_before_is_found(spark):
    old = START - dt.timedelta(days=9)
    got = attach(spark, [("g", old, -120, 0.02), ("other", START - dt.timedelta(hours=1), 5, 0.1)])
    assert (got["moneyline_home"], got["juice"]) == (-120, 0.02)


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    base = dt.datetime(2026, 1, 1)
    t = [base + dt.timedelta(hours=rng.randrange(200)) for _ in range(400)]
    quotes = [(rng.choice("ab"), t[i], i, float(i)) for i in range(300)]
    games = [(i, rng.choice("abc"), t[i]) for i in range(300, 400)]
    got = prior.asof_attach(
        spark.createDataFrame(games, "id int, game_id string, start timestamp_ntz"),
        spark.createDataFrame(quotes, QUOTES), "game_id", "start", "posted", ["moneyline_home"],
        tie_break="moneyline_home")
    for r in got.collect():
        before = [(q[1], q[2]) for q in quotes if q[0] == r["game_id"] and q[1] < r["start"]]
        assert r["moneyline_home"] == (max(before)[1] if before else None)
    assert got.count() == 100


# --- trailing days, latest state --------------------------------------------------------------------

def test_load_before_counts_the_three_days_before(spark):
    daily = spark.createDataFrame([("A", day(n), n) for n in (1, 2, 3, 4, 5)],
                                  "team string, day date, n int")
    games = spark.createDataFrame([("A", day(5)), ("A", day(9)), ("B", day(5)), ("A", day(7))],
                                  "team string, gd date")
    got = {(r["team"], r["gd"]): r["n3"] for r in prior.load_before(
        games, daily, "team", "gd", "day", 3, {"n3": "n"}).collect()}
    assert got == {("A", day(5)): 9, ("A", day(9)): None, ("B", day(5)): None, ("A", day(7)): 9}


def test_latest_values_skip_nulls(spark):
    df = spark.createDataFrame([("A", 1, 5.0, None), ("A", 2, None, 2.0), ("B", 1, None, None)],
                               "k string, seq int, x double, y double")
    got = {r["k"]: (r["x"], r["y"]) for r in prior.latest_values(
        df, "k", ["seq"], ["x", "y"]).collect()}
    assert got == {"A": (5.0, 2.0), "B": (None, None)}


def test_first_and_last_row(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 3, "z"), ("A", 2, "y")],
                               "k string, seq int, v string")
    assert prior.last_row(df, ["k"], ["seq"], ["v"]).first()["v"] == "z"
    assert prior.first_row(df, ["k"], ["seq"], ["v"]).first()["v"] == "x"


def test_ranges_of_a_hot_key_are_found_without_reading_every_cut(spark):
    """As many cuts lie below a value as a plain count says: before, on and after the ends, and for no value."""
    df = spark.createDataFrame([("a", x) for x in [*range(-2, 60), None]] + [("b", 5), (None, 5)], "k string, x int")
    for cuts in ([7], [3, 4, 20], list(range(0, 50, 3))):
        hot = spark.createDataFrame([("a", cuts)], "k string, cuts array<int>")
        for most in (len(cuts), 1_000_000):
            out = prior.Split(hot, ["k"], F.col("x"), most=most).assign(df)
            assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()
            for r in out.collect():
                want = sum(c < r["x"] for c in cuts) if r["x"] is not None else 0
                assert r["_slice"] == (want if r["k"] == "a" else None)


def test_tasks_are_sized_for_wide_rows(spark):
    """Some thirty MB of shuffled rows are dealt to several tasks; they went to one."""
    session.tune(spark)
    few = "spark.sql.adaptive.coalescePartitions.parallelismFirst"     # as if there were one core
    spark.conf.set(few, "false")
    try:
        wide = spark.range(0, 400_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 512).alias("k"))
        dealt = wide.groupBy("k").count().select(F.spark_partition_id().alias("p"))
        per_task = [r["count"] for r in dealt.groupBy("p").count().collect()]
    finally:
        spark.conf.unset(few)
    assert sum(per_task) == 400_000 and len(per_task) >= 3 and max(per_task) <= 150_000
