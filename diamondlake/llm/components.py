"""Connected components of an edge table, by labels that only travel through joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.session import Stage


def connected_components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is the smallest id reachable.

    Each round gives a node the smallest label among its neighbours and then the label of its
    label, which halves the distances; rounds are written to the stage. Labels of a node of many
    edges are combined before the shuffle. Self links and NULL ends are left out.
    """
    spark = edges.sparkSession
    clean = edges.filter("a <> b").select("a", "b")
    both = stage.put(f"{name}-edges", clean.union(clean.select("b", "a")).distinct())
    labels = stage.put(f"{name}-0", both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.min("a")).alias("label")))
    turn = 0
    while True:
        turn += 1
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        lower = labels.join(around, "id").select(
            "id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        root = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(root, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        written = stage.put(f"{name}-{turn}", jumped)
        labels = written.select("id", "label")
        if written.filter("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def extended_components(settled: DataFrame, edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(id, component) over the edges behind `settled` (id, component) and further ones.

    The further edges are drawn between the components they touch, so the rounds read these alone and not
    the edges that are settled.
    """
    ends = edges.select("a", "b").join(settled.toDF("a", "of_a"), "a", "left").join(
        settled.toDF("b", "of_b"), "b", "left")
    over = connected_components(ends.select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), stage, name)
    known = settled.join(over.toDF("component", "above"), "component", "left").select(
        "id", F.coalesce("above", "component").alias("component"))
    return stage.put(f"{name}-extended", known.union(over.join(settled.select("id"), "id", "left_anti")))
