"""Words one edit apart, grouped by their most frequent neighbour.

Letters are hashed to a few symbols, so the vocabulary becomes a smaller one of reduced words. Two words
one edit apart have reduced words at most one edit apart: the one-edit neighbourhood of every reduced
word is generated and joined with the reduced vocabulary, and what meets is verified on the words.
A neighbourhood is generated whole, but a pair of reduced words is named from one of its ends: the longer
one, or the later one of equal lengths (insertions at one end are deletions at the other).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import text_of
from diamondlake.llm.line_dedup import LOWER, UPPER
from diamondlake.session import Stage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, FACTOR = 5, 3, 2
SYMBOLS = "abcdefghijk"         # reduced words are written in these


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                least_count: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z lowered, of at least `least_chars` code points and `least_count` uses.

    With `typo_every` a run whose crc32 together with the id is divisible by it loses one letter, which
    plants misspellings. NULL text has no words; a NULL id reads as the empty string.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       text_of(text).alias("text")).select(
        "id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select(
        "id", F.translate("run", UPPER, LOWER).alias("word"))
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("word")))
    return (runs.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least_count))


def reduced(word: Column, symbols: str = SYMBOLS) -> Column:
    """The word with each letter hashed to one of the symbols."""
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.ascii(F.substring(word, i, F.lit(1))))
    return F.array_join(F.transform(letters, lambda c: F.substring(F.lit(symbols), c % len(symbols) + 1, F.lit(1))), "")


def neighbourhood(code: Column, symbols: str = SYMBOLS) -> Column:
    """The reduced words that `code` names: itself, those one deletion away, and those of its length
    that replace one symbol by an earlier one."""
    places = F.sequence(F.lit(1), F.length(code))
    head = lambda i: F.substring(code, F.lit(1), i - 1)
    tail = lambda i: F.substring(code, i + 1, F.length(code))
    shorter = F.array_distinct(F.transform(places, lambda i: F.concat(head(i), tail(i))))
    every = F.array(*[F.lit(s) for s in symbols])
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(every, lambda s: s < F.substring(code, i, F.lit(1))),
        lambda s: F.concat(head(i), s, tail(i)))))
    return F.concat(F.array(code), shorter, replaced)


def near_pairs(words: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of words (word, n) exactly one edit apart, once."""
    coded = words.select("word", "n", reduced(F.col("word"), symbols).alias("code"))
    asking = coded.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("code").alias("own"),
                          F.explode(neighbourhood(F.col("code"), symbols)).alias("code"))
    met = asking.join(coded.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "code"), "code")
    once = (F.col("own") != F.col("code")) | (F.col("a") < F.col("b"))
    return met.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def group_variants(words: DataFrame, factor: int = FACTOR, symbols: str = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of (word, n); words are distinct.

    Near are words one inserted, deleted or replaced code point apart; n_near counts them. The form of a
    word is its near word with the largest n (ties: the smallest in code-point order) if that n is at
    least `factor` times (2 or more) its own, else NULL; root follows forms to the last, and is the word
    itself without a form. Counts grow along the way, so there are no rings. The words may hold any
    code points. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("a factor below 2 does not bound the chains of forms")
    stage = Stage(words.sparkSession)
    words = stage.put("words", words.select("word", "n"))
    pairs = near_pairs(words, symbols)
    side = lambda w, m, v, n: F.struct(
        F.col(w).alias("word"), F.struct((-F.col(n)).alias("less"), F.col(v).alias("form")).alias("best"))
    ends = pairs.select(F.explode(F.array(side("a", "n_a", "b", "n_b"), side("b", "n_b", "a", "n_a"))).alias("e"))
    near = ends.select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= factor * F.col("n")
    named = stage.put("named", words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))

    # each round doubles the distance; chains are as long as counts can double at most
    roots, turn, moved = named.filter("form is not null").select("word", F.col("form").alias("root")), 0, True
    roots = stage.put("roots0", roots)
    while moved:
        turn += 1
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = stage.put(f"roots{turn}", roots.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        moved = not jumped.filter("moved").isEmpty()
        roots = jumped.select("word", "root")
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      typo_every: int | None = None, **options) -> DataFrame:
    """`group_variants` over the words of whole texts. NULL and empty texts have no words, repeated rows
    count again, extra columns are ignored; a table without words gives no rows."""
    return group_variants(count_words(docs, doc_id, text, typo_every=typo_every), **options)
