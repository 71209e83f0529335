"""Token counts by heap-and-linked-list byte-pair merging; no identifier is ever produced.

A word starts as its bytes. A heap of (rank, position) holds the adjacent pairs that a merge
knows; the lowest is popped, its right symbol joins the left one in a linked list, and the two
new neighbour pairs are pushed. The count is the number of initial symbols minus the merges.
Words repeat, so each worker remembers the counts of the words it met, up to a bound.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import ship_package, text_of

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
REMEMBER = 400_000      # distinct words a worker keeps, each of at most REMEMBER_LEN characters
REMEMBER_LEN = 64
#: fixed values: the white space of the vocabulary file's pattern engine
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class MergeCounter:
    """Counts tokens under a word-level byte-pair vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.first = [t[:2] for t in special]
        self.letters = _byte_letters()
        self.known = _Known(self)

    def count(self, text: str) -> int:
        """Tokens of a text; special strings inside it are one token each."""
        if self.special and any(f in text for f in self.first):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # letters are lowered one by one, so a capital sigma never takes its final form
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.known.__getitem__, self.words(text.lower())))

    def merged(self, word: str) -> int:
        """Symbols left when no known pair is adjacent any more."""
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        left = n = len(symbols)
        symbols[-1] += self.end
        if n == 1:
            return 1
        ranks = self.ranks
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:     # the pair is gone
                continue
            symbols[i], symbols[j] = a + b, ""
            left -= 1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((a + b, symbols[k]))) is not None:
                    heappush(heap, (rank, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((symbols[h], a + b))) is not None:
                heappush(heap, (rank, h, symbols[h], a + b))
        return left


class _Known(dict):
    def __init__(self, counter: MergeCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.merged(word)
        if len(word) <= REMEMBER_LEN:
            if len(self) >= REMEMBER:
                self.clear()
            self[sys.intern(word)] = n
        return n


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    `path` names the vocabulary file, which must be readable on every executor (the installed one
    by default, looked up where the task runs). NULL text counts as empty: 0 bytes, 0 tokens.
    Texts of any length are counted whole, in O(n log n). Repeated rows are counted each; extra
    columns are ignored; an empty table gives no rows. The plan has no shuffle.
    """

    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path or default_path()).count
        for batch in texts:
            yield batch.map(count).astype("int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).select(
        "doc_id", F.octet_length("_text").cast("long").alias("n_bytes"),
        tokens("_text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
