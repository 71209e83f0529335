"""Choose column types by what a table holds: ranges, missing values and numbers of distinct values.

One pass gives a row per column (`profile`); `chosen` names the narrowest type that holds every value,
`dictionary` gives the code table of strings of few values and `narrow` applies both. What the driver
reads is one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = 100        # a string column of fewer distinct values becomes codes
SKETCHED = 2            # columns whose sketch says up to this many times as many are counted exactly
RSD = 0.02

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SIMPLE = (*_WHOLE, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
           T.DecimalType)
_RANGES = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


def profile(df: DataFrame) -> DataFrame:
    """position, column, declared, n_rows, n_null, least, greatest, n_distinct of every plain column.

    least and greatest are NULL but for whole numbers. NaN counts as missing. n_distinct is the estimate
    of a sketch of relative deviation RSD. An empty table has n_rows 0 and NULL ranges; nested
    columns are left out. It is one aggregation with partial sums, whatever the number of columns.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, _SIMPLE)]
    if not fields:
        return df.sparkSession.createDataFrame([], _PROFILE)

    def of(place: int, f: T.StructField):
        col = _present(f)
        whole = isinstance(f.dataType, _WHOLE)
        return F.struct(
            F.lit(place).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("declared"), F.count("*").alias("n_rows"),
            (F.count("*") - F.count(col)).alias("n_null"),
            (F.min(col).cast("long") if whole else F.lit(None).cast("long")).alias("least"),
            (F.max(col).cast("long") if whole else F.lit(None).cast("long")).alias("greatest"),
            F.approx_count_distinct(col, RSD).alias("n_distinct"))

    return df.agg(F.array(*[of(k, f) for k, f in enumerate(fields)]).alias("columns")).select(
        F.inline("columns"))


_PROFILE = ("position int, column string, declared string, n_rows long, n_null long, least long, greatest long, "
            "n_distinct long")


def _present(f: T.StructField):
    col = F.col(f"`{f.name}`")
    return F.when(~F.isnan(col), col) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col


def chosen(df: DataFrame, profiled: DataFrame | None = None, categories: int = CATEGORIES) -> DataFrame:
    """The profile with `nullable`, `chosen` and, for strings that may be categories, the exact `n_values`.

    Whole numbers get the narrowest type whose range holds least and greatest (a column without
    values gets the narrowest), doubles become floats, strings of fewer than `categories` values become
    `category`. Columns whose sketch is far above the limit are not counted again; the others are counted
    exactly, so the choice does not depend on the sketch's error.
    """
    rows = profile(df) if profiled is None else profiled
    near = [r["column"] for r in rows.filter("declared = 'string'").filter(
        F.col("n_distinct") <= SKETCHED * categories).select("column").collect()]
    counts = [(c, len(v)) for c, v in _values(df, near, categories).items()]
    exact = df.sparkSession.createDataFrame(counts, "column string, n_values int")
    fits = F.lit(None).cast("string")
    for kind, bits in reversed(_RANGES):
        inside = (F.coalesce("least", F.lit(0)) >= -2 ** bits) & (F.coalesce("greatest", F.lit(0)) <= 2 ** bits - 1)
        fits = F.when(inside, kind).otherwise(fits)
    wholes = [k().simpleString() for k in _WHOLE]
    kind = (F.when(F.col("declared").isin(wholes), fits)
            .when(F.col("declared") == "double", "float")
            .when((F.col("declared") == "string") & (F.col("n_values") < categories), "category")
            .otherwise(F.col("declared")))
    return rows.join(F.broadcast(exact), "column", "left").select(
        *[c for c in rows.columns], (F.col("n_null") > 0).alias("nullable"), "n_values", kind.alias("chosen"))


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, code, value: the distinct values of string columns, numbered from 0 in code-point order.

    NULL has no code. Give columns of few values, as `chosen` names them: numbering is one task per column.
    """
    from pyspark.sql import Window

    rows = _distinct(df, columns)
    return rows.select("column", (F.row_number().over(
        Window.partitionBy("column").orderBy("value")) - 1).alias("code"), "value")


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


def _values(df: DataFrame, columns: list[str], categories: int) -> dict[str, list[str]]:
    """Sorted values of columns; the sketch has bounded their number to some hundreds before."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in dictionary(df, columns).filter(F.col("code") < categories).collect():
        out[r["column"]].append(r["value"])
    return out


def narrow(df: DataFrame, types: DataFrame | None = None, categories: int = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """The table in its chosen types, and the code table of its category columns.

    Category columns hold codes (tinyint); join the code table on (column, code) for the values. Codes are
    looked up in a map of at most `categories` entries a column, so no join is needed and none shuffles.
    """
    rows = {r["column"]: r for r in (chosen(df, categories=categories) if types is None else types).collect()}
    coded = [c for c, r in rows.items() if r["chosen"] == "category"]
    values = _values(df, coded, categories)
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name in values:
            codes = F.create_map(*[F.lit(x) for k, v in enumerate(values[f.name]) for x in (v, k)])
            col = F.try_element_at(codes, col).cast("tinyint") if values[f.name] else F.lit(None).cast("tinyint")
        elif f.name in rows:
            col = col.cast(rows[f.name]["chosen"])
        out.append(col.alias(f.name))
    return df.select(*out), dictionary(df, coded)
