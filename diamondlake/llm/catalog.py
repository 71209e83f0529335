"""The text operators bound to the test tables, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diamondlake.llm import (
    clustering,
    decontaminate,
    exact_dedup,
    line_dedup,
    main_text,
    mixing,
    near_dedup,
    quality,
    repeats,
    spelling,
    substrings,
    token_counts,
    url_filter,
)
from diamondlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark, d):
    out = mixing.mix(table(spark, d, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_decontaminate(spark, d):
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op3_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, d, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op4_token_counts(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"))


@query
def op5_repeats(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents"), keep_text=False).drop("kept")


@query
def op6_substrings(spark, d):
    return substrings.remove_substrings(table(spark, d, "documents"), keep_text=False).drop("kept")


@query
def op7_main_text(spark, d):
    return main_text.extract_main_text(table(spark, d, "pages"))


@query
def op8_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"), digest_all=True)


@query
def op9_url_filter(spark, d):
    return url_filter.filter_urls(table(spark, d, "pages"))


@query
def op10_near_dedup(spark, d):
    return near_dedup.near_dedup(table(spark, d, "documents"))


@query
def op11_clustering(spark, d):
    return clustering.cluster_vectors(table(spark, d, "embeddings"))


@query
def op12_line_dedup(spark, d):
    return line_dedup.drop_repeated_lines(table(spark, d, "documents"), keep_text=False)


@query
def op13_spelling(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"), typo_every=97)
