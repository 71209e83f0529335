"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The sort classifies every suffix as smaller (S) or larger (L) than the next one, sorts the leftmost
smaller (LMS) substrings by one induction, names them, sorts the shorter string of names, and
induces all suffixes from that order in two linear scans. The scans go bucket by bucket: all
entries of a bucket pass on their predecessors at once. As the alphabet of names is as large as
their string, the recursion on names ranks pairs of ranks, doubling the length ranked each time,
and stops when every name is alone or `depth` symbols are ranked.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions in the order of their suffixes.

    `text` has non-negative integers, best dense ones. With `depth`, suffixes that agree on so
    many symbols may come in any order. An empty text has an empty array.
    """
    if not len(text):
        return np.empty(0, np.int64)
    t = np.append(text.astype(np.int32) + 1, 0)         # the end is smaller than any symbol
    small = _small(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    top = int(t.max()) + 1
    if len(lms) > 1:
        place = np.zeros(len(t), bool)
        place[lms] = True
        order = _induced(t, small, lms, top)
        ranked = order[place[order]]
        lms = lms[_name_order(_names(t, lms, ranked), depth)]
    return _induced(t, small, lms, top)[1:]


def _small(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the end is."""
    n = len(t)
    step = np.sign(np.diff(t))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]     # the next place where symbols differ
    return np.append(step[np.minimum(nearest, n - 2)] > 0 if n > 1 else np.empty(0, bool), True)


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, top: int) -> np.ndarray:
    """All suffixes induced from LMS suffixes, which come in the order wanted for each symbol."""
    narrow = np.uint16 if top < 1 << 16 else np.uint32      # 16 bits are sorted by radix
    by_symbol = lms[np.argsort(t[lms].astype(narrow), kind="stable")]
    cuts = np.searchsorted(t[by_symbol], np.arange(top + 1))
    larger = [[] for _ in range(top)]
    larger_done = [None] * top
    none = np.empty(0, np.int64)

    def pass_on(waves, symbol, into, kind):
        """Predecessors of the waves, by type: those of other symbols go to their buckets."""
        prev = np.concatenate(waves) - 1 if waves else none
        prev = prev[prev >= 0]
        prev = prev[(small[prev] == kind) & (t[prev] != symbol)]
        if len(prev):
            symbols = t[prev].astype(narrow)
            order = np.argsort(symbols, kind="stable")
            prev, symbols = prev[order], symbols[order]
            edge = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            for part, first in zip(np.split(prev, edge), np.append(0, edge)):
                into[int(symbols[first])].append(part)

    def runs(wave, symbol, kind):
        """The entries of a bucket and those that they induce into it, in order."""
        waves = []
        while len(wave):
            waves.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == symbol) & (small[wave] == kind)]
        return waves

    for c in range(top):
        start = np.concatenate(larger[c]) if larger[c] else none
        waves = runs(start, c, False)
        larger_done[c] = np.concatenate(waves) if waves else none
        pass_on([larger_done[c], by_symbol[cuts[c]:cuts[c + 1]]], c, larger, False)
    smaller = [[] for _ in range(top)]
    smaller[0].append(np.array([len(t) - 1]))
    out = [none] * top
    for c in range(top - 1, -1, -1):
        start = np.concatenate(smaller[c]) if smaller[c] else none
        waves = runs(start, c, True)
        done = np.concatenate(waves) if waves else none         # from the right to the left
        out[c] = np.concatenate((larger_done[c], done[::-1]))
        pass_on([done, larger_done[c][::-1]], c, smaller, True)
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """The rank of the LMS substring at each LMS position, in text order."""
    index = np.zeros(len(t), np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(t) - 1)[index[ranked]]
    lengths = ends - ranked
    same = np.zeros(len(ranked), bool)
    open_ = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    k = 0
    while len(open_):               # compare neighbours symbol by symbol, both ends included
        open_ = open_[t[ranked[open_] + k] == t[ranked[open_ - 1] + k]]
        finished = lengths[open_] == k
        same[open_[finished]] = True
        open_ = open_[~finished]
        k += 1
    names = np.empty(len(lms), np.int64)
    names[index[ranked]] = np.cumsum(~same) - 1
    return names


def _name_order(names: np.ndarray, depth: int | None) -> np.ndarray:
    """The order of the suffixes of a string of names; a name spans two symbols of the text or more."""
    rank, covered = names, 1
    n = len(names)
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        if np.all(ordered[1:] != ordered[:-1]) or (depth is not None and 2 * covered >= depth):
            return order
        if covered >= n:
            return order
        after = np.zeros(n, np.int64)
        after[:-covered] = rank[covered:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) - 1
        covered *= 2


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """By text position, the length of the common prefix with the suffix before it in the array.

    Lengths are counted up to `most`. The first suffix of the array has 0.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    here = np.flatnonzero(before >= 0)
    padded = np.zeros(n + most + 8, np.uint8 if text.dtype == np.uint8 else np.uint32)
    padded[:n] = text
    there = before[here]
    room = np.minimum(n - np.maximum(here, there), most)
    step = max(1, 8 // padded.itemsize)
    wide = np.lib.stride_tricks.as_strided(
        padded.view(np.uint8), (n + most, 8), (padded.itemsize, 1)).view(np.uint64)[:, 0] \
        if padded.itemsize == 1 else None
    k = np.zeros(len(here), np.int64)
    open_ = np.arange(len(here))
    while wide is not None and len(open_):      # eight bytes at a time while they agree
        at = k[open_]
        go = (at + step <= room[open_]) & (wide[here[open_] + at] == wide[there[open_] + at])
        open_ = open_[go]
        k[open_] += step
    open_ = np.arange(len(here))
    while len(open_):
        at = k[open_]
        go = at < room[open_]
        open_, at = open_[go], at[go]
        open_ = open_[padded[here[open_] + at] == padded[there[open_] + at]]
        k[open_] += 1
    out[here] = k
    return out
