"""Lines that many documents share, dropped everywhere but in the first document that has them.

Lines are exploded with their position, normalised to a key (trimmed, A-Z lowered) and told apart by
128 bits of hash. A key counts once per document before documents are counted, so a line that a third
of all documents hold is combined map-side. Keys over the threshold are a table of one row each; lines
that meet it become a list of positions per row, and the texts move once, to meet their own list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import text_of
from diamondlake.session import Stage

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: the line trimmed of white space, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _digest(prefix: str, *columns: str) -> list[Column]:
    return [F.xxhash64(*columns).alias(f"{prefix}1"),
            F.xxhash64(F.lit(1), *columns).alias(f"{prefix}2")]


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                        keep_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, with `keep_text`, kept: one row per input row.

    Lines end at \\n. A key of at least `least_chars` code points that at least `least_docs` documents
    hold stays in the smallest id that holds it (every time it stands there) and is dropped elsewhere.

    NULL text counts as empty and has one empty line. Rows that repeat an id are one document: they
    keep or lose a line together. Rows with a NULL id have no place in the order: they keep all lines
    and do not count as holders. Shorter keys, empty lines among them, always stay. Extra columns are
    ignored. An empty table gives no rows. What one task holds of a document is its own lines.
    """
    stage = Stage(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), *_digest("row", "doc_id", "text"))
    known = rows.filter("doc_id is not null")
    lines = (known.select("doc_id", "row1", "row2", F.posexplode("lines").alias("at", "line"))
             .select("doc_id", "row1", "row2", "at", line_key(F.col("line")).alias("key"))
             .filter(F.length("key") >= least_chars)
             .select("doc_id", "row1", "row2", "at", *_digest("key", "key")))

    holders = lines.select("key1", "key2", "doc_id").distinct()
    # written, so that both sides of the join are plain exchanges, which AQE can split where a line is hot
    shared = stage.put("shared", holders.groupBy("key1", "key2").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first"))
        .filter(F.col("n_docs") >= least_docs).drop("n_docs"))
    dropped = stage.put("dropped", lines.join(shared, ["key1", "key2"]).filter("doc_id > first")
                        .groupBy("row1", "row2").agg(F.sort_array(F.collect_set("at")).alias("gone")))

    judged = known.join(dropped, ["row1", "row2"], "left").select("doc_id", "lines", "gone")
    free = rows.filter("doc_id is null").select("doc_id", "lines", F.lit(None).cast("array<int>").alias("gone"))
    # positions are whole numbers, which array_except looks up in a hash set
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.transform(stay, lambda i: F.get(F.col("lines"), i))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left), "\n")
    out = judged.unionByName(free).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept")] if keep_text else []))
    return out
