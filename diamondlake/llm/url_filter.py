"""URL rules by a Bloom filter cascade: exact membership in a list without a join.

Level 1 encodes the listed keys. The keys of the corpus that pass it without being listed are
encoded by level 2, the listed keys that pass level 2 by level 3, and so on until a level has no
false positive. As the universe (every key the corpus can ask for) is complete, the first level
that says no decides, always rightly. Levels are sized by the keys they encode, level 1 with a
false positive rate of listed / universe, so that all levels together grow with the list and the
logarithm of the corpus. They travel as arrays in the plan; a list that would need more than
MAX_WORDS words raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlake.session import Stage

#: fixed values of the contract: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_WORDS = 1 << 21     # 64-bit words of one level (16 MB)
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level:
    """A Bloom filter whose words are a literal of the plan."""

    def __init__(self, keys: DataFrame, n_keys: int, rate: float, seed: int):
        rate = min(max(rate, 1e-9), 0.5)
        self.seed, self.hashes = seed, max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n_keys * -math.log2(rate) / math.log(2)))
        self.n_words = (bits + 63) // 64
        if self.n_words > MAX_WORDS:
            raise ValueError(f"a level of {self.n_words} words passes MAX_WORDS; split the list")
        at = keys.select(F.explode(F.array(*self._bits(F.col("key")))).alias("bit"))
        found = at.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
        words = [0] * self.n_words
        for word, mask in found.collect():      # at most n_words rows, checked above
            words[word] = mask
        self.words = words

    def _bits(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 1000 + i)), F.lit(self.n_words * 64))
                for i in range(self.hashes)]

    def may_hold(self, key: Column) -> Column:
        words = F.lit(self.words)
        hit = F.lit(True)
        for bit in self._bits(key):
            word = F.element_at(words, (F.floor(bit / 64) + 1).cast("int"))
            hit &= F.getbit(word, (bit % 64).cast("int")) == 1
        return hit


class Cascade:
    """Exact for every key of `universe`; `listed` and `universe` have a column key."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """`listed` must be small enough for MAX_WORDS; `universe` is staged and distinct.

        NULL keys are never listed. An empty list gives a cascade without levels: no to every key.
        """
        stage = Stage(universe.sparkSession)
        listed = stage.put("listed", listed.filter("key is not null").distinct())
        others = stage.put("others", universe.filter("key is not null").join(
            listed, "key", "left_anti"))
        self.levels: list[Level] = []
        encode, against = listed, others
        rate = None
        while (n := encode.count()) and len(self.levels) < MAX_LEVELS:
            if rate is None:
                rate = n / max(2, others.count())
            level = Level(encode, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            passed = against.filter(level.may_hold(F.col("key")))
            encode, against, rate = stage.put(f"level{len(self.levels)}", passed), encode, 0.5
        if encode.count():
            raise RuntimeError("the cascade does not end: keys collide in every hash")

    def holds(self, key: Column) -> Column:
        """True if the key is listed. Level 1, 3, ... pass listed keys; 2, 4, ... the others."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            no = F.lit(i % 2 == 0)      # what a no of this level means
            out = F.when(self.levels[i - 1].may_hold(key), out).otherwise(no)
        return F.coalesce(out, F.lit(False))


def split_url(url: str) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path; both empty without '://' or for NULL."""
    after = F.when(F.instr(F.col(url), "://") > 0,
                   F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A key is a host suffix with a path prefix of a length that some rule has. Each url asks for
    its own keys, longest first, and the first listed key is its rule. A url without a rule is
    allowed: rule NULL.

    NULL urls and urls without '://' have an empty host and path, thus no rule. Repeated rows are
    judged alike, each for itself. Extra columns are ignored. An empty table gives no rows; no
    rules allow everything. Equally long rules: the longer host wins; a key that is listed twice
    takes block.
    """
    spark = pages.sparkSession
    host, path = split_url(url)
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return split.select("*", F.lit(None).cast("string").alias("rule"),
                            F.lit("allow").alias("verdict"))
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    keys = _keys(lengths)
    universe = split.select("host", "path").distinct().select(
        F.explode(F.transform(keys, lambda k: k["key"])).alias("key")).distinct()
    universe = Stage(spark).put("universe", universe)
    cascades = {}
    blocked = {(h, p) for v, h, p in rules if v == "block"}
    for verdict in ("block", "allow"):
        own = [(h + p,) for v, h, p in rules
               if v == verdict and (verdict == "block" or (h, p) not in blocked)]
        cascades[verdict] = Cascade(spark.createDataFrame(own, "key string"), universe)
    judged = split.withColumn("_hit", F.get(F.filter(
        F.transform(keys, lambda k: F.struct(
            k["key"].alias("key"), cascades["block"].holds(k["key"]).alias("block"),
            cascades["allow"].holds(k["key"]).alias("allow"))),
        lambda k: k["block"] | k["allow"]), F.lit(0)))
    return judged.select("page_id", "host", "path", F.col("_hit.key").alias("rule"),
                         F.when(F.col("_hit.block"), "block").otherwise("allow").alias("verdict"))


def _keys(lengths: Sequence[int]) -> Column:
    """Host suffixes with path prefixes, the longest key first, as structs of (n, h, key)."""
    labels = F.split(F.col("host"), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n),
                           lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(F.array(*[F.substring("path", 1, k) for k in lengths]),
                        lambda p: F.length(p).isin(*lengths))
    prefixes = F.array_distinct(prefixes)
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("n"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.array_sort(pairs)
