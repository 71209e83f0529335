"""Word passages that repeat across documents, by fixed-block anchors.

Every window of WINDOW words holds a whole block of half that length at a multiple of the half.
So the non-overlapping blocks of all documents are the index, and every rolling window of a half
is a probe.

1. Each shard sends its probes to buckets, flagged where one is an indexed block. A bucket marks the
   keys that are a block somewhere and occur in two documents: the anchors.
2. A shard extends its anchors to all windows that hold one, and sends these windows with the
   smallest document that has them. The bucket answers whether a smaller document has them too.
   Runs of answered windows are the maximal exact repeats.
3. The shard removes the words they cover.

A probe travels as about three bytes, a window of an anchor as about twelve; answers are bits.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm import arrays
from diamondlake.llm import shards as X
from diamondlake.llm.common import ship_package

WINDOW = 50
REMOVED = "doc_id long, has_id boolean, n_words long, n_removed long, kept_sha256 string, kept string"


class _Shard:
    """The words of a shard's documents, its probes and its windows."""

    def __init__(self, docs: pd.DataFrame, n_buckets: int, window: int):
        docs = docs.sort_values("id", kind="stable")
        self.ids = docs["id"].to_numpy()
        self.has_id = docs["has_id"].to_numpy(dtype=bool)
        self.texts = arrays.encoded(docs["text"])
        self.n, self.window, self.half = n_buckets, window, window // 2
        self.words, self.counts = arrays.word_hashes(self.texts)
        ends = np.cumsum(self.counts)
        left = np.repeat(ends, self.counts) - np.arange(len(self.words))
        self.doc = np.repeat(np.arange(len(docs)), self.counts)
        usable = self.has_id[self.doc]
        halves = arrays.window_hashes(self.words, self.half)
        self.halves = halves
        # equal documents ids are one document: number the ids, not the rows
        self.number = np.unique(self.ids, return_inverse=True)[1]
        self.at = np.flatnonzero((left >= self.half) & usable)
        key = X.bucketed(halves[self.at], n_buckets)
        order = np.argsort(key, kind="stable")      # documents stay in order within a key
        self.keys, first = _first(key[order])
        self.rank = np.empty(len(key), np.int64)
        self.rank[order] = np.cumsum(first) - 1
        self.first, self.order = np.flatnonzero(first), order
        self.left = left

    def probes(self) -> pd.DataFrame:
        own = self.doc[self.at]
        start = np.cumsum(self.counts) - self.counts
        block = (self.at - start[own]) % self.half == 0
        n = len(self.keys)
        is_block = np.bincount(self.rank, weights=block, minlength=n) > 0
        number = self.number[own][self.order]
        last = np.append(self.first[1:], len(number)) - 1
        many = number[self.first] != number[last] if n else np.zeros(0, bool)
        low = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bounds = X.bucket_bounds(self.keys, self.n)
        return _sent(bounds, lambda lo, hi: X.planes(low[lo:hi]) + X.bits(is_block[lo:hi]) + X.bits(many[lo:hi]))

    def extend(self, anchors: pd.DataFrame) -> None:
        """Windows that hold an anchor, with their keys and smallest document."""
        live = X.answered(anchors, X.bucket_bounds(self.keys, self.n))
        here = np.zeros(len(self.words) + 1, np.int64)
        here[self.at[live[self.rank]] + 1] = 1
        held = np.cumsum(here)          # anchors that start before a place
        starts = self.at[self.left[self.at] >= self.window]
        starts = starts[held[starts + self.window - self.half + 1] > held[starts]]
        a, b = self.halves[starts], self.halves[starts + self.half]
        b = b if self.window % 2 == 0 else b ^ self.words[starts + self.window - 1]
        full = arrays.mixed(a * arrays.MIX_A + b)
        bucket = arrays.mixed(a ^ (b * arrays.MIX_B)) >> np.uint64(32)
        bucket = (bucket % np.uint64(self.n)).astype(np.int64)
        order = np.lexsort((full, bucket))          # stable: documents stay in order
        full, bucket = full[order], bucket[order]
        first = np.ones(len(full), bool)
        first[1:] = (full[1:] != full[:-1]) | (bucket[1:] != bucket[:-1])
        self.starts, self.win_order = starts, order
        self.win_rank = np.cumsum(first) - 1
        self.win_keys, self.win_bucket = full[first], bucket[first]
        self.win_number = self.number[self.doc[starts]]
        self.win_first = self.win_number[order][first]
        self.win_bounds = np.searchsorted(self.win_bucket, np.arange(self.n + 1))

    def windows(self) -> pd.DataFrame:
        smallest = np.unique(self.ids)[self.win_first] if len(self.win_first) else np.zeros(0, np.int64)
        base = int(smallest.min()) if len(smallest) else 0
        narrow = len(smallest) == 0 or int(smallest.max()) - base < 1 << 32
        offset = (smallest - base).astype(np.uint32) if narrow else smallest.view(np.uint64)
        head = np.array([base, narrow], np.int64).tobytes()
        return _sent(self.win_bounds, lambda lo, hi: head + X.planes(self.win_keys[lo:hi])
                     + X.planes(offset[lo:hi]))

    def removed(self, seen: pd.DataFrame) -> np.ndarray:
        """One flag per word."""
        earlier = X.answered(seen, self.win_bounds)[self.win_rank]
        later = self.win_number[self.win_order] > self.win_first[self.win_rank]
        gone = self.starts[self.win_order[earlier | later]]
        return X.spread(len(self.words), gone, self.window)


def _first(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the flags of their first places."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first], first


def _sent(bounds: np.ndarray, data) -> pd.DataFrame:
    full = np.flatnonzero(np.diff(bounds))
    return pd.DataFrame({"bucket": full.astype(np.int32), "n": np.diff(bounds)[full],
                         "data": [data(int(bounds[b]), int(bounds[b + 1])) for b in full]})


def _anchors(sent: pd.DataFrame) -> pd.DataFrame:
    """Per shard, the keys that are a block somewhere and occur in two documents."""
    keys, block, many = [], [], []
    for n, data in zip(sent["n"].tolist(), sent["data"].tolist()):
        m = -(-n // 8)
        keys.append(X.unplanes(data, np.uint32, n))
        block.append(X.unbits(data[4 * n:4 * n + m], n))
        many.append(X.unbits(data[4 * n + m:], n))
    every = np.concatenate(keys)
    values, where = np.unique(every, return_inverse=True)
    times = np.bincount(where, minlength=len(values)) > 1
    times |= np.bincount(where, weights=np.concatenate(many), minlength=len(values)) > 0
    times &= np.bincount(where, weights=np.concatenate(block), minlength=len(values)) > 0
    return _answer(sent, times[where])


def _earlier(sent: pd.DataFrame) -> pd.DataFrame:
    """Per shard, the windows that a smaller document of another shard has."""
    keys, ids = [], []
    for n, data in zip(sent["n"].tolist(), sent["data"].tolist()):
        base, narrow = np.frombuffer(data, np.int64, 2).tolist()
        keys.append(X.unplanes(data[16:], np.uint64, n))
        rest = data[16 + 8 * n:]
        ids.append(X.unplanes(rest, np.uint32, n).astype(np.int64) + base if narrow
                   else X.unplanes(rest, np.int64, n))
    every, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    _, first = _first(every[order])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    seen = np.empty(len(every), bool)
    seen[order] = least < ids[order]
    return _answer(sent, seen)


def _answer(sent: pd.DataFrame, flags: np.ndarray) -> pd.DataFrame:
    """The flags, in the order of what was sent, as one row of bits for each sender."""
    ends = np.cumsum(sent["n"].to_numpy())
    return pd.DataFrame({"bucket": sent["bucket"], "shard": sent["shard"], "n": sent["n"],
                         "data": [X.bits(flags[e - n:e]) for e, n in zip(ends, sent["n"])]})


def _round(n_buckets: int, window: int, step: int, keep_text: bool):
    """What a shard does in round `step`, given its documents and the answers so far."""
    def shard(key, docs, answers):
        if not len(docs):
            return pd.DataFrame(columns=["bucket", "shard", "n", "data"])
        own = _Shard(docs, n_buckets, window)
        own.extend(answers[answers["step"] == 1])
        if step == 2:
            return own.windows().assign(shard=np.int32(key[0]))
        return _kept(own, own.removed(answers[answers["step"] == 2]), keep_text)
    return shard


def _kept(own: _Shard, gone: np.ndarray, keep_text: bool) -> pd.DataFrame:
    ends = np.cumsum(own.counts)
    removed = np.bincount(own.doc[gone], minlength=len(own.ids))
    digests, texts = [], []
    for k, text in enumerate(own.texts):
        words = text.split()            # bytes split at the same six characters
        if removed[k]:
            words = compress(words, (~gone[ends[k] - own.counts[k]:ends[k]]).tolist())
        kept = b" ".join(words)
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode("utf-8", "surrogatepass") if keep_text else None)
    return pd.DataFrame({"doc_id": own.ids, "has_id": own.has_id, "n_words": own.counts,
                         "n_removed": removed, "kept_sha256": digests, "kept": texts})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay) of every row.

    A word goes if a window of `window` words over it also starts in a document with a smaller id;
    windows are judged on the input. Words are unchanged runs of non-blank characters; kept joins
    them by one space and is NULL unless `keep_text`. The id is a long.

    NULL text counts as empty: no words. Shorter texts than a window lose nothing. Rows that
    repeat an id are one document: they do not remove each other. A NULL id has no order: such rows
    are returned whole and remove nothing. Extra columns are ignored; an empty table gives no
    rows. Texts are read whole; a shard holds a whole text, so the longest must fit a task.
    Windows are told apart by 64 bits and their bucket.
    """
    ship_package(docs.sparkSession)
    parts = X.sharded(docs, doc_id, text)
    n = parts.n

    def probes(key, rows):
        return _Shard(rows, n, window).probes().assign(shard=np.int32(key[0]))

    by_shard = parts.docs.groupBy("shard")
    sent = by_shard.applyInPandas(probes, X.PACKED)
    anchors = sent.groupBy("bucket").applyInPandas(_anchors, X.PACKED).withColumn("step", F.lit(1))
    extended = by_shard.cogroup(anchors.groupBy("shard")).applyInPandas(
        _round(n, window, 2, keep_text), X.PACKED)
    seen = extended.groupBy("bucket").applyInPandas(_earlier, X.PACKED).withColumn("step", F.lit(2))
    done = by_shard.cogroup(anchors.unionByName(seen).groupBy("shard")).applyInPandas(
        _round(n, window, 3, keep_text), REMOVED)
    return done.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_words",
                       "n_removed", "kept_sha256", "kept")
