"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

A text is digested in full only if another text has its length and its prefix. Counts are
partial aggregates over narrow keys; the texts move once, to meet the groups that survived the
prefix, and AQE splits the partition of a hot group there (the other side has one row per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import text_of

PREFIX = 64  # characters


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX,
                digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays. text_sha256 is NULL where no refinement had
    to read the whole text, unless `digest_all`.

    NULL text counts as empty, so empty and NULL texts form one group. Rows that repeat both id
    and text are counted in group_size and share their fate (kept if the id is the largest). A
    NULL id is smaller than any other; a group with NULL ids only has keep_id NULL and keeps them.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).select(
        "doc_id", "_text", F.length("_text").alias("_len"),
        F.xxhash64(F.substring("_text", 1, prefix)).alias("_head"))

    lengths = rows.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("_len")
    by_head = rows.groupBy("_len", "_head").agg(F.count("*").alias("_n")).filter("_n > 1")
    heads = by_head.join(lengths, "_len", "left_semi").select(
        "_len", "_head", F.lit(True).alias("_shared"))

    full = F.sha2("_text", 256)
    marked = rows.join(heads, ["_len", "_head"], "left").select(
        "doc_id", "_len", "_head", F.when(F.col("_shared"), full).alias("_full"),
        *([full.alias("text_sha256")] if digest_all else []))
    groups = marked.filter("_full is not null").groupBy("_full").agg(
        F.count("*").alias("_n"), F.max("doc_id").alias("_keep"))
    # rows without a digest meet no group; a key of their own spreads them over all tasks
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("_len", "_head")).otherwise(F.xxhash64("doc_id"))
    alone = F.concat(F.lit("#"), spread.cast("string"))
    out = marked.withColumn("_key", F.coalesce("_full", alone)).join(
        groups.withColumnRenamed("_full", "_key"), "_key", "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("text_sha256" if digest_all else "_full").alias("text_sha256"))
