"""Bind the generic test tables to the shapes the operators expect.

Each frame is a projection written as SQL expressions that Spark and DuckDB read alike, so the
oracle queries start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# one row per order = one game of a league
GAMES = {
    "game_pk": "o_orderkey",
    "game_date": "cast(o_orderdate as date)",
    "season": "cast(year(o_orderdate) as int)",
    # thirty customers that meet each other: leagues grow in number with the orders, not in size
    "league": "cast(cast(floor(o_custkey / 30) as bigint) as string)",
    "home_team": "concat('T', cast(o_custkey % 30 as string))",
    "away_team": "concat('T', cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as string))",
    "home_win": "case o_orderstatus when 'F' then 1 when 'O' then 0 end",
    "home_score": "cast(o_custkey % 7 + case o_orderstatus when 'F' then 1 + o_orderkey % 4 "
                  "when 'O' then 0 else 2 end as int)",
    "away_score": "cast(o_custkey % 7 + case o_orderstatus when 'O' then 1 + o_orderkey % 4 "
                  "when 'F' then 0 else 2 end as int)",
    "prob": "cast((o_custkey * 37 + o_orderkey * 11) % 1000 as double) / cast(1000 as double)",
    "home_starter_id": "o_custkey % 97",
    "away_starter_id": "(o_custkey + 31 + o_orderkey % 13) % 97",
    "o_totalprice": "o_totalprice",
}

# one row per order line = one pitch; lines of equal number form a plate appearance
PITCHES = {
    "game_pk": "l_orderkey",
    "game_date": "cast(o_orderdate as date)",
    "game_type": "'R'",
    "home_team": "concat('T', cast(o_custkey % 30 as string))",
    "away_team": "concat('T', cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as string))",
    "inning": "cast(floor((l_linenumber + 1) / 2) as int)",
    "inning_topbot": "case when l_linenumber % 2 = 1 then 'Top' else 'Bot' end",
    "outs_when_up": "cast(l_partkey % 3 as int)",
    "balls": "cast(l_suppkey % 4 as int)",
    "strikes": "cast(l_partkey % 3 as int)",
    "on_1b": "case when l_partkey % 3 = 0 then cast(l_suppkey as double) end",
    "on_2b": "case when l_partkey % 4 = 0 then cast(l_suppkey as double) end",
    "on_3b": "case when l_suppkey % 5 = 0 then cast(l_partkey as double) end",
    "at_bat_number": "cast(l_linenumber as int)",
    "pitch_number": "(l_partkey * 1000000 + l_suppkey) * 100 + cast(l_quantity as bigint)",
    "pitcher": "l_suppkey",
    "batter": "l_partkey % 300",
    "p_throws": "case when l_suppkey % 4 = 0 then 'L' else 'R' end",
    "stand": "case l_partkey % 7 when 0 then 'L' when 1 then 'L' when 2 then null else 'R' end",
    "pitch_type": "case l_partkey % 6 when 0 then 'FF' when 1 then 'SI' when 2 then 'SL' "
                  "when 3 then 'CH' when 4 then 'CU' end",
    "release_speed": "cast(80 as double) + l_quantity / 4",
    "description": "case when l_partkey % 9 < 4 then 'hit_into_play' "
                   "when l_partkey % 9 < 6 then 'swinging_strike' else 'ball' end",
    "events": "case (l_partkey + l_linenumber) % 13 when 0 then 'single' when 1 then 'double' "
              "when 2 then 'home_run' when 3 then 'walk' when 4 then 'strikeout' "
              "when 5 then 'hit_by_pitch' when 6 then 'grounded_into_double_play' "
              "when 7 then 'triple' when 8 then 'force_out' when 9 then null "
              "when 10 then 'stolen_base' else 'field_out' end",
    "launch_speed": "case when l_partkey % 11 > 0 then cast(60 as double) + l_quantity end",
    "launch_angle": "round(l_discount * 400, 0)",
    "estimated_woba_using_speedangle": "case when l_suppkey % 6 > 0 then round(l_tax * 10, 1) end",
    "home_score": "cast(floor(l_linenumber * (o_custkey % 3) / 2) as int)",
    "away_score": "cast(floor(l_linenumber * (o_orderkey % 4) / 3) as int)",
    "player_name": "concat('Last', cast(l_suppkey as string), ', First')",
}

# one row per user and day; views are quotes, purchases are starts
EVENT_DAY = "cast(ts as date)"


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def games(spark: SparkSession, folder: str) -> DataFrame:
    return project(table(spark, folder, "orders"), GAMES)


def pitches(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return project(lines.join(orders, lines.l_orderkey == orders.o_orderkey), PITCHES)


def games_sql(*names: str) -> str:
    cols = names or tuple(GAMES)
    return "select " + ", ".join(f"{GAMES[n]} as {n}" for n in cols) + " from orders"


def pitches_sql(*names: str) -> str:
    cols = names or tuple(PITCHES)
    return ("select " + ", ".join(f"{PITCHES[n]} as {n}" for n in cols)
            + " from lineitem join orders on l_orderkey = o_orderkey")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Decided games with the stand-in probability, as prediction rows."""
    return games(spark, folder).where(F.col("home_win").isNotNull())


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "events").where("event_type = 'view'")
            .selectExpr("user_id", "ts as posted_at", "value as line", "event_id as quote_id"))


def starts(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "events").where("event_type = 'purchase'")
            .selectExpr("event_id", "user_id", "ts as start_time"))
