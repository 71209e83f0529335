"""Read and conform landed pitch files, game files and schedule feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlake import constants as K
from diamondlake.functions import scalars as S


# --- schema ----------------------------------------------------------------------------------------

def rename_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Vendor spellings to canonical names; a canonical column that is present wins."""
    aliases = K.COLUMN_ALIASES if aliases is None else aliases
    taken = set(df.columns)
    renames, extra = {}, []
    for name in df.columns:
        target = aliases.get(name)
        if target and target != name:
            if target in taken:
                extra.append(name)
            else:
                renames[name] = target
                taken.add(target)
    return df.drop(*extra).withColumnsRenamed(renames)


def conform(df: DataFrame, types: dict[str, str] | None = None,
            aliases: dict[str, str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Declared columns with declared types, missing ones as typed NULL, unparsable values NULL.

    Further columns pass through; unused ones go. NaN becomes NULL, which is the only missing
    value the operators know.
    """
    types = K.PITCH_TYPES if types is None else types
    drop = K.UNUSED_COLUMNS if drop is None else drop
    df = rename_aliases(df, aliases)
    out = []
    for name, kind in types.items():
        if name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        col, have = F.col(name), df.schema[name].dataType
        if isinstance(have, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        if have.simpleString() != kind:
            col = (F.to_date(F.try_to_timestamp(col)) if kind == "date"
                   and isinstance(have, T.StringType)
                   else col.try_cast(kind) if isinstance(have, T.StringType)
                   else col.cast(kind))
        out.append(col.alias(name))
    rest = [c for c in df.columns if c not in types and c not in drop]
    return df.select(*out, *rest)


def downcast(df: DataFrame, small_ints: Sequence[str] = ()) -> DataFrame:
    """Narrow doubles to float and the named integers to short.

    A value that does not fit raises, so name only columns with known ranges. Strings of few
    values need no own type: Parquet stores them as a dictionary.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif f.name in small_ints and isinstance(f.dataType, (T.LongType, T.IntegerType)):
            c = c.cast("smallint")
        out.append(c.alias(f.name))
    return df.select(*out)


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order, without repeats."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


# --- pitch files -----------------------------------------------------------------------------------

def read_pitches(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def read_landed(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Landed pitch batches with game dates in [start, end]; the filter reaches the scan."""
    df = spark.read.parquet(path)
    day = F.col("game_date")
    return conform(df.where((day >= F.lit(start).cast("date"))
                            & (day < F.date_add(F.lit(end).cast("date"), 1))))


def date_bounds(df: DataFrame, day: str = "game_date") -> DataFrame:
    """Earliest and latest date; reads one column, answered from Parquet statistics if possible."""
    return df.agg(F.min(day).alias("earliest"), F.max(day).alias("latest"))


# --- game files ------------------------------------------------------------------------------------

def read_games(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Game features from CSV (give the schema to skip inference) or Parquet."""
    if str(path).rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    return spark.read.parquet(path)


def prepare_games(df: DataFrame) -> DataFrame:
    """Canonical team codes, game id and start time where absent, feature copies."""
    df = df.withColumns({"home_team": S.canonical_team("home_team"),
                         "away_team": S.canonical_team("away_team"),
                         "game_date": F.to_date("game_date")})
    if "game_id" not in df.columns:
        df = df.withColumn("game_id", S.game_id("game_date", "away_team", "home_team"))
    if "game_pk" not in df.columns:
        df = df.withColumn("game_pk", F.col("game_id"))
    if "start_time_utc" not in df.columns:
        df = df.withColumn("start_time_utc", S.default_start("game_date"))
    return copy_features(df)


def copy_features(df: DataFrame) -> DataFrame:
    """Copy feature columns under their model name unless that name exists."""
    return df.withColumns({new: F.col(old) for old, new in K.FEATURE_COPIES.items()
                           if old in df.columns and new not in df.columns})


# --- schedule feed ---------------------------------------------------------------------------------

_SIDE = ("struct<homeAway:string,score:string,team:struct<abbreviation:string>,"
         "probablePitcher:struct<fullName:string>>")
SCOREBOARD = (f"events array<struct<date:string,competitions:array<struct<"
              f"competitors:array<{_SIDE}>,venue:struct<fullName:string>>>>>")


def read_scoreboard(spark: SparkSession, path: str) -> DataFrame:
    """Landed scoreboard documents: files of one JSON document each, or of one per line.

    A file whose lines all begin and end as objects holds one document per line. Feeds are small
    files, of a day each, which one task reads whole.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: x != "")
    per_line = F.forall(lines, lambda x: x.startswith("{") & x.endswith("}"))
    documents = files.select(F.explode(F.when(per_line, lines).otherwise(
        F.array("value"))).alias("doc"))
    return parse_scoreboard(documents.select(
        F.from_json("doc", SCOREBOARD).alias("j")).select("j.*"))


def parse_scoreboard(documents: DataFrame) -> DataFrame:
    """One row per scheduled game. Events without both sides or with a bad date are left out."""
    game = (documents.select(F.explode("events").alias("e"))
            .select(F.col("e.date").alias("_date"),
                    F.try_element_at("e.competitions", F.lit(1)).alias("c"))
            .where(F.size("c.competitors") == 2))

    def side(name):
        return F.try_element_at(F.filter("c.competitors", lambda x: x["homeAway"] == name),
                                F.lit(1))

    def probable(name):
        full = F.col(f"{name}.probablePitcher.fullName")
        return F.when(F.length(full) > 0, full).otherwise("TBD")

    rows = (game.select("_date", side("home").alias("home"), side("away").alias("away"),
                        F.coalesce("c.venue.fullName", F.lit("Unknown")).alias("venue"))
            .where(F.col("home").isNotNull() & F.col("away").isNotNull())
            .withColumn("_ts", F.coalesce(  # seconds may be missing
                F.try_to_timestamp("_date"),
                F.try_to_timestamp("_date", F.lit("yyyy-MM-dd'T'HH:mmX"))))
            .where(F.col("_ts").isNotNull())
            .select(
                S.utc_naive("_ts").alias("start_time_utc"),
                S.canonical_team(F.coalesce("home.team.abbreviation", F.lit(""))).alias("home_team"),
                S.canonical_team(F.coalesce("away.team.abbreviation", F.lit(""))).alias("away_team"),
                S.digits_to_int("home.score").alias("home_score"),
                S.digits_to_int("away.score").alias("away_score"),
                probable("home").alias("sp_name_home"), probable("away").alias("sp_name_away"),
                "venue"))
    both = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return rows.withColumn("game_date", F.to_date("start_time_utc")).withColumns({
        "home_win": F.when(both, (F.col("home_score") > F.col("away_score")).cast("double")),
        "total_runs": F.col("home_score") + F.col("away_score"),
        "game_id": S.game_id("game_date", "away_team", "home_team")})


def schedule_on(schedule: DataFrame, day) -> DataFrame:
    return schedule.where(F.col("game_date") == F.lit(day).cast("date"))


def schedule_on_or_before(schedule: DataFrame, day, back: int = 7) -> DataFrame:
    """The latest day with games in the `back` days up to `day`."""
    d = F.lit(day).cast("date")
    window = schedule.where(F.col("game_date").between(F.date_sub(d, back), d))
    latest = window.agg(F.max("game_date").alias("_latest"))  # one row
    return window.join(F.broadcast(latest), F.col("game_date") == F.col("_latest")).drop("_latest")


def between_dates(df: DataFrame, start, end, day: str = "game_date") -> DataFrame:
    """Inclusive date range; swapped ends are put right."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.where(F.col(day).between(F.least(a, b), F.greatest(a, b)))
