"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last
one adds `copy`, the number of each emitted copy (`copy_` where documents have a `copy`). Rows with a
NULL id cannot be named in a decision about ids and pass the stages 8, 10 and 2. Empty tables pass as
empty tables. Rows travel as one struct beside what a stage computes, so extra columns of any name come
through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diamondlake.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from diamondlake.llm.common import table, text_of
from diamondlake.session import Stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as label 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("text"))
    # written, as a filter on the score would move below the statistics and repeat them for each term
    scored = Stage(spark).put("scored", quality.score(rows, model).select("row", "predicted"))
    return scored.filter("predicted = 1").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. Only rows judged copies go: where an id repeats
    with different texts, its other texts stay."""
    # written, as a filter on what is kept would move below the joins and have the texts moved once more
    judged = Stage(spark).put("judged", exact_dedup.exact_dedup(docs))
    copies = judged.filter("not kept").select(
        F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.sha2(text_of(), 256).alias("digest"))
    return rows.join(copies, ["id", "digest"], "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id."""
    return _without(docs, near_dedup.near_dedup(docs).filter("not kept"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source"),
                       keep=["_row"])
    number = "copy" if "copy" not in docs.columns else "copy_"
    return mixing.emitted(mixed).select("_row.*", F.col("copy").alias(number))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    ids = dropped.select("doc_id").filter("doc_id is not null").distinct()
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
]
ORACLE_SQL = None       # classifier, near duplicates and BM25 are beyond SQL: see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next."""
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.put(f"step{k}", step(spark, docs, sf_dir))
    return docs
