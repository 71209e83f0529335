"""Byte strings that occur again, removed with suffix arrays over the places that can repeat.

Every string of WINDOW bytes has an anchor: the half of it with the smallest hash. Equal strings
have equal anchors, so strings that occur twice can be looked for anchor by anchor.

1. Each shard sends the anchors of its windows to buckets, which mark those that occur twice.
2. A shard sends each marked anchor's context, the bytes of all windows it anchors (at most one and
   a half windows), once for equal contexts, with its first place. A bucket folds equal contexts,
   sorts all suffixes of the others by induced sorting, and takes permuted common prefixes:
   neighbours that share WINDOW bytes are one string, and its first place stays.
3. The shard removes the bytes that the answered windows cover.

An anchor in very many places (HOT) sends single windows by their own hash instead, so that no
bucket gathers all its contexts; within a shard equal ones are one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm import arrays
from diamondlake.llm import shards as X
from diamondlake.llm.common import ship_package
from diamondlake.llm.suffixes import permuted_prefixes, suffix_array

WINDOW = 100
HOT = 4096
PIECE = 1 << 20
PLACE = 24                  # bits of a place within a piece
ALONE = 255                 # instead of an anchor's offset: a window on its own
END = 0xFF                  # no byte of UTF-8
REMOVED = ("doc_id long, has_id boolean, n_bytes long, n_removed long, n_spans long, "
           "kept_sha256 string, kept string")


class _Shard:
    """The bytes of a shard's documents and the blocks of windows that share an anchor."""

    def __init__(self, docs: pd.DataFrame, n_buckets: int, window: int):
        docs = docs.sort_values(["id", "text"], kind="stable")
        self.ids = docs["id"].to_numpy()
        self.has_id = docs["has_id"].to_numpy(dtype=bool)
        self.n, self.window, self.half = n_buckets, window, window // 2
        texts = arrays.encoded(docs["text"])
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        parts = [self._blocks(lo) for lo in range(0, len(self.buf), PIECE)]
        parts = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
        self.lo, self.hi, self.anchor = parts[:3]
        self.hash = parts[3].view(np.uint64)
        keys = X.bucketed(self.hash, n_buckets)
        self.keys, self.rank, self.times = np.unique(keys, return_inverse=True, return_counts=True)
        self.bounds = X.bucket_bounds(self.keys, n_buckets)

    def _blocks(self, at: int) -> tuple[np.ndarray, ...]:
        """First and last window, anchor and its hash of the blocks that start in a piece."""
        width, half = self.window, self.half
        count = self.window - half + 1                      # places of an anchor in a window
        stop = min(len(self.buf), at + PIECE)
        data = self.buf[at:min(len(self.buf), stop + width)]
        places = np.arange(at, stop)
        row = np.searchsorted(self.ends, places, side="right")
        fits = np.flatnonzero((self.ends[row] - places >= width) & self.has_id[row])
        if not len(fits):
            return (np.empty(0, np.int64),) * 4
        hashes = arrays.window_hashes(data, half)
        mask = np.uint64((1 << PLACE) - 1)
        ranked = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(ranked, count)[fits]
        anchor = (least & mask).astype(np.int64)
        new = np.ones(len(fits), bool)
        new[1:] = (np.diff(fits) != 1) | (np.diff(anchor) != 0) | (row[fits[1:]] != row[fits[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(fits)) - 1
        return (fits[first] + at, fits[last] + at, anchor[first] + at,
                hashes[anchor[first]].view(np.int64))

    def anchors(self) -> pd.DataFrame:
        low = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        times = np.minimum(self.times, 255).astype(np.uint8)
        return _sent(self.bounds, lambda lo, hi: X.planes(low[lo:hi]) + times[lo:hi].tobytes())

    def extend(self, marks: pd.DataFrame) -> None:
        """The contexts of marked anchors, folded where equal."""
        live = X.answered(marks[["bucket"]].assign(data=marks["data"].map(lambda d: d[:len(d) // 2])), self.bounds)
        hot = X.answered(marks[["bucket"]].assign(data=marks["data"].map(lambda d: d[len(d) // 2:])), self.bounds)
        use, hot = live[self.rank], hot[self.rank]
        plain, split = np.flatnonzero(use & ~hot), np.flatnonzero(use & hot)
        counts = self.hi[split] - self.lo[split] + 1
        single = np.repeat(self.lo[split] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        lo = np.concatenate((self.lo[plain], single))
        hi = np.concatenate((self.hi[plain], single))
        offset = np.concatenate((self.anchor[plain] - self.lo[plain], np.full(len(single), ALONE)))
        order = np.argsort(lo, kind="stable")
        lo, hi, offset = lo[order], hi[order], offset[order]
        content = arrays.span_hashes(self.buf, lo, hi + self.window)
        meet = np.concatenate((self.hash[plain], np.zeros(len(single), np.uint64)))[order]
        meet = np.where(offset == ALONE, content, meet)
        # equal contexts of equal anchors are one, the first in the order of places
        content = arrays.mixed(content ^ (meet * arrays.MIX_A) ^ offset.astype(np.uint64))
        bucket = (meet >> np.uint64(32)) % np.uint64(self.n)
        by = np.lexsort((content, bucket))
        c, b = content[by], bucket[by]
        first = np.ones(len(by), bool)
        first[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        self.lo_all, self.hi_all = lo, hi
        self.head = by[first]                                       # in the order they are sent
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(first) - 1
        self.is_head = np.zeros(len(by), bool)
        self.is_head[self.head] = True
        self.head_offset = offset[self.head].astype(np.uint8)
        self.head_bounds = np.searchsorted(b[first], np.arange(self.n + 1, dtype=np.uint64))
        self.windows = hi[self.head] - lo[self.head] + 1
        self.window_bounds = np.append(0, np.cumsum(self.windows))

    def contexts(self) -> pd.DataFrame:
        lo, n = self.lo_all[self.head], len(self.head)
        row = np.searchsorted(self.ends, lo, side="right")
        starts = self.ends - self.sizes
        same = np.searchsorted(self.ids, self.ids[row])             # the first row of the id
        ids, place = self.ids[row], lo - starts[same] if n else lo
        lengths = self.windows + self.window - 1
        take = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        text, cut = self.buf[take], np.append(0, np.cumsum(lengths))
        return _sent(self.head_bounds, lambda a, z: b"".join((
            X.planes(ids[a:z]), X.planes(place[a:z]), X.planes(lengths[a:z].astype(np.uint32)),
            self.head_offset[a:z].tobytes(), text[cut[a]:cut[z]].tobytes())))

    def removed(self, replies: pd.DataFrame) -> np.ndarray:
        """One flag per byte."""
        flags = X.answered(replies, self.window_bounds[self.head_bounds])
        again = ~self.is_head
        gone = [np.flatnonzero(flags)]
        owner = np.repeat(np.arange(len(self.head)), self.windows)
        at = self.lo_all[self.head][owner] + np.arange(len(owner)) - self.window_bounds[owner]
        gone = at[gone[0]]
        lo, counts = self.lo_all[again], self.hi_all[again] - self.lo_all[again] + 1
        whole = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return X.spread(len(self.buf), np.concatenate((gone, whole)), self.window)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` values; runs past the end take what is there."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:n + width - 1])


def _sent(bounds: np.ndarray, data) -> pd.DataFrame:
    full = np.flatnonzero(np.diff(bounds))
    return pd.DataFrame({"bucket": full.astype(np.int32), "n": np.diff(bounds)[full],
                         "data": [data(int(bounds[b]), int(bounds[b + 1])) for b in full]})


def _marks(hot: int):
    def marks(sent):
        """Per shard, the anchors in two places and those in very many."""
        keys, times = [], []
        for n, data in zip(sent["n"].tolist(), sent["data"].tolist()):
            keys.append(X.unplanes(data, np.uint32, n))
            times.append(np.frombuffer(data, np.uint8, n, 4 * n))
        values, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(times), minlength=len(values))[where]
        ends = np.cumsum(sent["n"].to_numpy())
        data = [X.bits(total[e - n:e] > 1) + X.bits(total[e - n:e] > hot)
                for e, n in zip(ends, sent["n"])]
        return pd.DataFrame({"bucket": sent["bucket"], "shard": sent["shard"], "n": sent["n"],
                             "data": data})
    return marks


def _repeated(window: int):
    def repeated(sent):
        """Per shard, one flag for each window of its contexts: it occurs earlier."""
        ids, places, lengths, offsets, texts = [], [], [], [], []
        for n, data in zip(sent["n"].tolist(), sent["data"].tolist()):
            ids.append(X.unplanes(data, np.int64, n))
            places.append(X.unplanes(data[8 * n:], np.int64, n))
            lengths.append(X.unplanes(data[16 * n:], np.uint32, n).astype(np.int64))
            offsets.append(np.frombuffer(data, np.uint8, n, 20 * n))
            texts.append(data[21 * n:])
        count = np.array([len(i) for i in ids])
        ids, places, lengths, offsets = map(np.concatenate, (ids, places, lengths, offsets))
        flags = _earlier(np.frombuffer(b"".join(texts), np.uint8), lengths, offsets,
                         np.lexsort((places, ids)), window)
        windows = np.append(0, np.cumsum(lengths - window + 1))
        cut = np.append(0, np.cumsum(count))
        data = [X.bits(flags[windows[a]:windows[z]]) for a, z in zip(cut[:-1], cut[1:])]
        return pd.DataFrame({"bucket": sent["bucket"], "shard": sent["shard"], "n": sent["n"],
                             "data": data})
    return repeated


def _earlier(buf: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, order: np.ndarray,
             window: int) -> np.ndarray:
    """One flag per window of the contexts: an equal window is in a context earlier in the order."""
    n, half = len(lengths), window // 2
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    starts = np.cumsum(lengths) - lengths
    content = arrays.span_hashes(buf, starts, starts + lengths)
    by = np.lexsort((rank, content))
    first = np.ones(n, bool)
    first[1:] = content[by][1:] != content[by][:-1]
    folded = np.ones(n, bool)
    folded[by[first]] = False
    windows = lengths - window + 1
    base = np.cumsum(windows) - windows
    flags = np.repeat(folded, windows)
    # different contexts of one anchor: sort their suffixes
    at = starts + np.where(offsets == ALONE, 0, offsets)
    anchor = arrays.span_hashes(buf, at, at + half)
    left = np.flatnonzero(~folded & (offsets != ALONE))
    _, where, times = np.unique(anchor[left], return_inverse=True, return_counts=True)
    left = left[times[where] > 1]
    if len(left):
        sizes = lengths[left] + 1
        text = np.full(int(sizes.sum()), END, np.uint8)
        begin = np.cumsum(sizes) - sizes
        inside = np.repeat(np.arange(len(left)), lengths[left])
        step = np.arange(len(inside)) - np.repeat(np.cumsum(lengths[left]) - lengths[left], lengths[left])
        text[begin[inside] + step] = buf[starts[left][inside] + step]
        owner = np.repeat(np.arange(len(left)), sizes)
        place = np.arange(len(text)) - begin[owner]
        array = suffix_array(text, window)
        array = array[place[array] < windows[left][owner[array]]]       # the starts of windows
        prefix = permuted_prefixes(text, array, window)
        group = np.flatnonzero(prefix[array] < window)
        ranks = rank[left][owner[array]]
        least = np.repeat(np.minimum.reduceat(ranks, group), np.diff(np.append(group, len(array))))
        again = array[ranks > least]
        flags[base[left][owner[again]] + place[again]] = True
    return flags


def _kept(own: _Shard, gone: np.ndarray, keep_text: bool) -> pd.DataFrame:
    removed, spans, digests, texts = [], [], [], []
    for end, size in zip(own.ends.tolist(), own.sizes.tolist()):
        part, flags = own.buf[end - size:end], gone[end - size:end]
        n = int(np.count_nonzero(flags))
        kept = part[~flags].tobytes() if n else part.tobytes()
        removed.append(n)
        spans.append(int(np.count_nonzero(flags[1:] & ~flags[:-1]) + flags[0]) if n else 0)
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode("utf-8", "replace") if keep_text else None)
    return pd.DataFrame({"doc_id": own.ids, "has_id": own.has_id, "n_bytes": own.sizes,
                         "n_removed": removed, "n_spans": spans, "kept_sha256": digests,
                         "kept": texts})


def remove_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      window: int = WINDOW, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of every row.

    A byte goes if a string of `window` bytes over it also starts earlier: in a smaller id, or in
    the same document before. Strings are judged on the input and never cross documents. n_spans
    counts the maximal removed runs; kept is the rest as text (a cut inside a letter shows as a
    replacement character; the digest is over the bytes) and NULL unless `keep_text`.

    NULL text counts as empty. Texts shorter than a window lose nothing. Rows that repeat an id
    are one document, read in the order of their texts; strings do not cross them. A NULL id has
    no order: such rows are returned whole and remove nothing. Extra columns are ignored; an empty
    table gives no rows. Texts are read whole; a shard holds a whole text, so the longest must fit
    a task. `window` is at most 250.
    """
    ship_package(docs.sparkSession)
    parts = X.sharded(docs, doc_id, text)
    n = parts.n

    def anchors(key, rows):
        return _Shard(rows, n, window).anchors().assign(shard=np.int32(key[0]))

    def contexts(key, rows, answers):
        if not len(rows):
            return pd.DataFrame(columns=["bucket", "shard", "n", "data"])
        own = _Shard(rows, n, window)
        own.extend(answers[answers["step"] == 1])
        return own.contexts().assign(shard=np.int32(key[0]))

    def kept(key, rows, answers):
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in REMOVED.split(", ")])
        own = _Shard(rows, n, window)
        own.extend(answers[answers["step"] == 1])
        return _kept(own, own.removed(answers[answers["step"] == 2]), keep_text)

    by_shard = parts.docs.groupBy("shard")
    sent = by_shard.applyInPandas(anchors, X.PACKED)
    marks = sent.groupBy("bucket").applyInPandas(_marks(hot), X.PACKED).withColumn("step", F.lit(1))
    extended = by_shard.cogroup(marks.groupBy("shard")).applyInPandas(contexts, X.PACKED)
    repeated = extended.groupBy("bucket").applyInPandas(_repeated(window), X.PACKED).withColumn(
        "step", F.lit(2))
    done = by_shard.cogroup(marks.unionByName(repeated).groupBy("shard")).applyInPandas(kept, REMOVED)
    return done.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_bytes",
                       "n_removed", "n_spans", "kept_sha256", "kept")
