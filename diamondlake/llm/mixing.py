"""Mixing sources to target weights: floor(rate) copies and one hash-seeded Bernoulli copy.

Sizes are summed per source (partial aggregation, so a hot source is one small row per task), the
targets are worked out on that one-row-per-source table, and each document meets its source's
rate. The rate table is broadcast only when its row count has been checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diamondlake.llm.common import n_words, text_of
from diamondlake.session import Stage

WEIGHTS = (5, 2, 1)
MOST = 3                # copies of a document, and of a source, at most
SEED = "mix"
FEW_SOURCES = 10_000    # rate tables up to here are broadcast, larger ones are joined by shuffle


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, source_size, target and rate, from rows of (_source, size).

    All sizes together are shared by weight; no target passes `most` times its source's size and
    the excess goes to the others by weight. In the order of most * size / weight the sources that
    stop are a prefix, so running sums replace the repeated resharing.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weighed = per.select("_source", "source_size",
                         F.element_at(listed, (rank % len(weights)) + 1).cast("long").alias("_w"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    open_ = weighed.select(
        "*", (F.sum("source_size").over(every)
              - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))).alias("_left"),
        (F.sum("_w").over(every)
         - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_weight"))
    # a source stops if its share of what is left by those before it passes its limit
    stops = F.col("source_size") * most * F.col("_weight") < F.col("_w") * F.col("_left")
    flagged = open_.withColumn("_stops", stops)
    first = Window.partitionBy().orderBy(F.col("source_size") / F.col("_w"),
                                         F.col("_source").asc_nulls_last())
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c: F.first(F.when(~F.col("_stops"), F.col(c)), ignorenulls=True).over(whole)
    target = F.when(F.col("_stops"), (F.col("source_size") * most).cast("double")).otherwise(
        (F.col("_w") * at("_left")).cast("double") / at("_weight").cast("double"))
    return flagged.select("_source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on nothing but the key and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2 ** 32))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED,
        keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: `keep`, doc_id, size, source_size, target, copies and taken.

    copies is floor(rate) plus one with the probability of the fraction; taken = copies * size.
    The same documents always get the same copies, whatever their order or partitioning.

    NULL text has size 0. Rows with a NULL source form a source of their own, ordered last. A
    source of size 0 has target 0 and is not taken. Repeated rows are documents of their own that
    share the draw of their id; NULL ids share one draw. Clashing extra columns are ignored, but
    for those in `keep`, which must not be named like a result. An empty table gives no rows.
    """
    sized = docs.select(*keep, F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                        n_words(text_of(text)).alias("size"))
    stage = Stage(docs.sparkSession)
    rates = stage.put("rates", source_targets(sized.select("_source", "size"), weights, most))
    if rates.count() <= FEW_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.alias("d").join(rates.alias("r"), F.col("d._source").eqNullSafe(F.col("r._source")))
    whole = F.floor("rate")
    copies = (whole + (chance(F.col("_id"), seed) < F.col("rate") - whole).cast("long")).cast("long")
    return joined.select(*keep, F.col("_id").alias("doc_id"), "size", "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mixed rows, each as often as it is taken, with its number as `copy`."""
    return mixed.withColumn("copy", F.explode(
        F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))))
