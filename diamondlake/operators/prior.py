"""Point-in-time operators: everything here looks only at rows strictly before the current one.

Ordered windows run one task per key. A key that holds a large part of the rows would leave one
task with all the work, so the window operators accept a `Split`: hot keys are cut into ranges of
the ordering value that different tasks handle, and what a range needs from earlier ones (the last
n rows, or running totals) is handed over through small per-range tables. Results are the same
with and without a split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlake.session import Stage

HOT_ROWS = 2_000_000          # rows of one key that a single window task may get
BROADCAST_KEYS = 10_000       # more hot keys than this are joined by shuffle instead
_SLICE = "_slice"


def filter_prior(df: DataFrame, as_of, time_col: str = "start_time_utc") -> DataFrame:
    """Rows that start strictly before `as_of`."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return df.where(F.col(time_col) < moment)


# --- hot keys --------------------------------------------------------------------------------------

@dataclass
class Split:
    """Hot keys, one row each, with the points at which their ordering value is cut."""

    hot: DataFrame
    keys: list[str]
    by: Column
    small: bool = True
    most: int = 1_000_000         # no key has more cuts

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the range number: NULL for rows of ordinary keys, which stay whole.

        The number of cuts below the row's value is found by halving steps, as a key may have as
        many cuts as there are days.
        """
        hot = self.hot.select(*[F.col(k).alias(f"_hot_{k}") for k in self.keys],
                              F.col("cuts").alias("_cuts"))
        hot = F.broadcast(hot) if self.small else hot
        same = reduce(lambda a, b: a & b,
                      [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys])
        by = self.by
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(self.most.bit_length()))])

        def ahead(at: Column, step: Column) -> Column:     # past the last cut `get` is NULL
            return at + F.when(F.get("_cuts", at + step - 1) < by, step).otherwise(0)

        return (df.join(hot, same, "left")
                .withColumn(_SLICE, F.when(F.col("_cuts").isNotNull(),
                                           F.aggregate(steps, F.lit(0), ahead)))
                .drop("_cuts", *[f"_hot_{k}" for k in self.keys]))


def hot_split(rows: DataFrame, keys: Sequence[str], by: Column,
              limit: int = HOT_ROWS) -> Split | None:
    """Find keys with more than `limit` rows; None when there are none, the usual case.

    Rows are counted with partial counts ahead of the shuffle. `by` is a number that grows with
    the order used later; for hot keys it is cut at approximate quantiles into ranges of about
    `limit` rows. There are at most rows/limit hot keys, and their number is checked before they
    are broadcast.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).count().where(F.col("count") > limit)
    n, largest = counts.agg(F.count(F.lit(1)), F.max("count")).first()
    if not n:
        return None
    pieces = max(2, -(-largest // limit))
    grid = [i / pieces for i in range(1, pieces)]
    wanted = counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    small = n <= BROADCAST_KEYS
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    hot = (rows.join(F.broadcast(wanted) if small else wanted, same, "left_semi")
           .groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, grid, max(10_000, 4 * pieces)))
                               .alias("cuts")))
    # several windows read it: written once, at most one row per hot key
    return Split(Stage(rows.sparkSession).put("hot_keys", hot), keys, by, small,
                 pieces - 1)


def day_of(col: str) -> Column:
    return F.unix_date(F.to_date(col))


# --- windows over the last n rows ------------------------------------------------------------------

_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
              "last": F.last}


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int,
             aggs: dict[str, tuple[str, str]], split: Split | None = None) -> DataFrame:
    """Add `aggs` ({name: (function, column)}) over the `rows` rows before the current one.

    `order` must rank the rows of a key without ties.
    """
    keys, order = list(keys), list(order)

    def with_windows(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-rows, -1)
        return frame.withColumns({n: _FUNCTIONS[f](F.col(c)).over(w) for n, (f, c) in aggs.items()})

    if split is None:
        return with_windows(df, keys)

    columns = df.columns
    sliced = split.assign(df)
    carried = list(dict.fromkeys([*order, *[c for _, c in aggs.values() if c not in keys]]))
    newest = Window.partitionBy(*keys, _SLICE).orderBy(*[F.desc(c) for c in order])
    tails = (sliced.where(F.col(_SLICE).isNotNull())
             .select(*keys, _SLICE, *[c for c in carried if c not in keys])
             .withColumn("_rank", F.row_number().over(newest))
             .where(F.col("_rank") <= rows)
             .groupBy(*keys, _SLICE)
             .agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_tail")))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(-rows, -1)
    halo = (tails
            .withColumn("_before", F.flatten(F.collect_list("_tail").over(earlier)))
            .select(*keys, _SLICE, F.explode(F.slice(
                F.col("_before"),
                F.greatest(F.size("_before") - (rows - 1), F.lit(1)), F.lit(rows))).alias("_row"))
            .select(*keys, _SLICE, *[F.col("_row")[c].alias(c) for c in carried if c not in keys],
                    F.lit(True).alias("_halo")))
    both = sliced.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    return (with_windows(both, [*keys, _SLICE]).where(~F.col("_halo"))
            .select(*columns, *aggs))


def rolling_prior_mean(df: DataFrame, key: str, value: str, order: Sequence[str], window: int,
                       min_periods: int = 1, name: str = "rolling_mean",
                       split: Split | None = None) -> DataFrame:
    """Mean of the previous `window` rows, NULL with fewer than `min_periods` observed values."""
    out = trailing(df, [key], order, window,
                   {"_mean": ("avg", value), "_seen": ("count", value)}, split)
    return (out.withColumn(name, F.when(F.col("_seen") >= min_periods, F.col("_mean")))
            .drop("_mean", "_seen"))


# --- windows over all earlier rows -----------------------------------------------------------------

def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            sums: dict[str, str], split: Split | None = None) -> DataFrame:
    """Add sums ({name: column}) over all earlier rows of the key; NULL before the first value.

    Doubles are summed as decimals of nine places, so a sum does not depend on where it is split.
    """
    keys, order = list(keys), list(order)
    columns = df.columns
    doubles = [n for n, c in sums.items() if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    if doubles:
        exact = {f"_x_{n}": F.col(sums[n]).cast("decimal(28,9)") for n in doubles}
        out = running(df.withColumns(exact), keys, order,
                      {n: f"_x_{n}" if n in doubles else c for n, c in sums.items()}, split)
        return out.withColumns({n: F.col(n).cast("double") for n in doubles}).drop(*exact)

    exact = {c for c in sums.values() if isinstance(df.schema[c].dataType, T.DecimalType)}

    def kept(total: Column, c: str) -> Column:      # sums of sums must not lose places
        return total.cast("decimal(30,9)") if c in exact else total

    def with_windows(frame: DataFrame, part: list[str]) -> DataFrame:
        w = (Window.partitionBy(*part).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
        return frame.withColumns({n: kept(F.sum(c).over(w), c) for n, c in sums.items()})

    if split is None:
        return with_windows(df, keys)

    sliced = split.assign(df)
    totals = (sliced.where(F.col(_SLICE).isNotNull()).groupBy(*keys, _SLICE)
              .agg(*[kept(F.sum(c), c).alias(f"_t_{n}") for n, c in sums.items()]))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    brought = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_SLICE).alias("_k_slice"),
        *[kept(F.sum(f"_t_{n}").over(earlier), c).alias(f"_b_{n}") for n, c in sums.items()])
    same = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
                  + [F.col(_SLICE) == F.col("_k_slice")])
    local = with_windows(sliced, [*keys, _SLICE]).join(brought, same, "left")
    return local.select(*columns, *[
        F.when(F.col(n).isNotNull() | F.col(f"_b_{n}").isNotNull(),
               F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n)
        for n in sums])


# --- as-of -----------------------------------------------------------------------------------------

def asof_attach(starts: DataFrame, quotes: DataFrame, key: str, start_time: str, quote_time: str,
                values: Sequence[str], defaults: dict | None = None,
                tie_break: str | None = None) -> DataFrame:
    """Attach to each start the latest quote of the same key posted strictly before it.

    Starts and quotes are laid on one time line per (key, day), so the work of one key is spread
    over its days and no pair of start and quote is ever formed; the last quote of earlier days
    comes from a table with one row per (key, day).
    """
    names = starts.columns
    quote = F.struct(F.col(quote_time).alias("_at"),
                     (F.col(tie_break) if tie_break else F.lit(0)).alias("_tie"),
                     *[F.col(v) for v in values])
    line = starts.select(
        F.col(key).alias("_key"), F.col(start_time).alias("_ts"), F.lit(0).alias("_kind"),
        F.lit(0).cast("bigint").alias("_seq"), F.struct(*names).alias("_start"),
    ).unionByName(quotes.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(quote_time).alias("_ts"), F.lit(1).alias("_kind"),
        (F.col(tie_break) if tie_break else F.lit(0)).cast("bigint").alias("_seq"),
        quote.alias("_quote")), allowMissingColumns=True)
    line = line.withColumn("_day", day_of("_ts"))

    per_day = (line.groupBy("_key", "_day")
               .agg(F.max_by("_quote", F.when(F.col("_kind") == 1, F.struct("_ts", "_seq")))
                    .alias("_last")))
    earlier = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_day.select("_key", "_day",
                             F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    # starts sort before quotes of the same instant: an equal time is not "before"
    within = (Window.partitionBy("_key", "_day").orderBy("_ts", "_kind", "_seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    found = (line.withColumn("_seen", F.last("_quote", ignorenulls=True).over(within))
             .where(F.col("_kind") == 0)
             .join(carried, ["_key", "_day"], "left")
             .withColumn("_hit", F.coalesce("_seen", "_carried")))
    defaults = defaults or {}
    attached = [
        F.when(F.col("_hit").isNull(), F.lit(defaults[v])).otherwise(F.col("_hit")[v]).alias(v)
        if v in defaults else F.col("_hit")[v].alias(v) for v in values]
    return found.select("_start.*", *attached)


# --- trailing days ---------------------------------------------------------------------------------

def trailing_days(daily: DataFrame, keys: Sequence[str], day: str, days: int,
                  sums: dict[str, str], include_today: bool = False) -> DataFrame:
    """Sums over the calendar days before each day. `daily` has one row per key and day."""
    w = (Window.partitionBy(*keys).orderBy(F.unix_date(day))
         .rangeBetween(-(days - 1), 0) if include_today else
         Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-days, -1))
    return daily.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})


def load_before(events: DataFrame, daily: DataFrame, key: str, event_day: str, day: str,
                days: int, sums: dict[str, str]) -> DataFrame:
    """Sums of `daily` over the `days` days before each event, whether or not it has rows that day.

    Every daily row is sent to the `days` days it counts for, so the range condition becomes an
    equality and no range join is needed. `daily` has one row per key and day.
    """
    spread = (daily.withColumn("_for", F.explode(F.sequence(
        F.date_add(day, 1), F.date_add(day, days))))
        .groupBy(F.col(key).alias("_k"), "_for")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    return (events.join(spread, (F.col(key) == F.col("_k")) & (F.col(event_day) == F.col("_for")),
                        "left").drop("_k", "_for"))


# --- latest state ----------------------------------------------------------------------------------

def latest_values(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the last non-null value of each column. Partial aggregation, no sort."""
    rank = F.struct(*order)
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), rank)).alias(v) for v in values]))


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             columns: Sequence[str]) -> DataFrame:
    """The last row of each group as an aggregate, so groups of any size stay partial."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              columns: Sequence[str]) -> DataFrame:
    picked = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")
