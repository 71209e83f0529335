"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diamondlake.session import ship_package  # noqa: F401

#: a word is a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The column as text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")
