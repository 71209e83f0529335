"""Benchmark decontamination: BM25 with block-max WAND over the test items, then verification.

The test items are the indexed side and every passage of every document is a query. Impacts are
divided by the item's own threshold, so a passage is retrieved when its sum reaches 1. An item's
threshold is its full score less its largest impacts, as many as words can be lost while the
overlap asked for is still reached: retrieval drops no passage that verification would accept.

A query begins with the terms that an item cannot do without (its rarer ones; the others together
stay below the threshold). That bound is taken for all passages of a batch at once; the passages
that reach it are scored by block-max WAND over the full posting lists. Retrieved passages are
compared with the item word by word: shingles of the whole item, of its question (all sentences
but the last) and the words of its answer (the last sentence, if it has five words or more).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlake.llm import arrays
from diamondlake.llm.common import ship_package, text_of

WORDS, OVERLAP = 5, 0.75
ANSWER_OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 8                       # postings of a block
MAX_ITEMS = 20_000              # items of one index; longer lists are indexed in parts
RESULT = ("doc_id long, item_id long, score double, overlap double, question_overlap double, "
          "answer_overlap double, first_word long")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str) -> list[str]:
    return _SPLIT(text.translate(_FOLD))


def shingled(words: Sequence[str], width: int = WORDS) -> set[tuple[str, ...]]:
    """Distinct runs of `width` words; the whole sequence if it is shorter."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of the last sentence.

    Both are all words if there is one sentence, or if the last one is shorter than a shingle: such an
    end ("N.") is part of the question, as one changed word in it would hide a whole copy.
    """
    parts = [p for p in re.split(r"(?<=[.?!])[\x20\x09-\x0D]+", text.strip()) if split_words(p)]
    words = [split_words(p) for p in parts]
    if len(words) < 2 or len(words[-1]) < WORDS:
        every = [w for p in words for w in p]
        return every, every
    return [w for p in words[:-1] for w in p], words[-1]


class Index:
    """Inverted index of test items; impacts are shares of the item's threshold."""

    def __init__(self, items: Sequence[tuple[int, str]], overlap: float = OVERLAP):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.words = [split_words(t) for _, t in items]
        n = len(items)
        self.length = max((len(w) for w in self.words), default=1)
        mean = sum(map(len, self.words)) / max(1, n)
        df = Counter(t for w in self.words for t in set(w))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.needed: list[tuple[str, int, float]] = []      # essential (term, item, impact)
        self.need = np.zeros(n)
        for i, words in enumerate(self.words):
            tf = Counter(words)
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1)
                      / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in tf.items()}
            may_miss = int((1 - overlap) * len(shingled(words)) + 1e-9)
            lost = sum(sorted(impact.values(), reverse=True)[:may_miss])
            # without a bound from the words that may be missing, one shingle must be there
            threshold = max(sum(impact.values()) - lost, sum(sorted(impact.values())[:WORDS])) - 1e-9
            spare = 0.0
            for t in sorted(impact, key=lambda t: (-df[t], t)):
                share = impact[t] / threshold
                self.postings.setdefault(t, []).append((i, share))
                if spare + share <= 0.5:
                    spare += share
                else:
                    self.needed.append((t, i, share))
            self.need[i] = 1 - spare - 1e-9
        self.most = {t: max(s for _, s in p) for t, p in self.postings.items()}
        self.blocks = {t: [max(s for _, s in p[k:k + BLOCK]) for k in range(0, len(p), BLOCK)]
                       for t, p in self.postings.items()}
        terms = sorted({t for t, _, _ in self.needed})
        rank = {t: k for k, t in enumerate(terms)}
        hashes = arrays.word_hashes([t.encode("utf-8", "surrogatepass") for t in terms])[0]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        new = np.empty(len(terms), np.int64)
        new[order] = np.arange(len(terms))
        entries = sorted((int(new[rank[t]]), i, s) for t, i, s in self.needed)
        self.at = np.searchsorted([e[0] for e in entries], np.arange(len(terms) + 1))
        self.entry_item = np.array([e[1] for e in entries], np.int64)
        self.entry_share = np.array([e[2] for e in entries])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def reachable(self, words: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """The passages whose essential terms leave some item within reach.

        `passages` has two columns: for each word the number of the last passage that holds it
        and that of the one before, -1 if only one does.
        """
        hit = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.hashes, words[hit])
        known = self.hashes[np.minimum(term, len(self.hashes) - 1)] == words[hit]
        hit, term = hit[known], term[known]
        counts = self.at[term + 1] - self.at[term]
        entry = np.repeat(self.at[term] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) \
            + np.arange(counts.sum())
        place = np.repeat(passages[hit], counts, axis=0)
        place, entry = np.concatenate((place[:, 0], place[:, 1])), np.concatenate((entry, entry))
        n = len(self.entry_item)
        once = np.unique((place * n + entry)[place >= 0])
        pair = once // n * len(self.ids) + self.entry_item[once % n]
        pairs, where = np.unique(pair, return_inverse=True)
        total = np.bincount(where, weights=self.entry_share[once % n], minlength=len(pairs))
        return np.unique(pairs[total >= self.need[pairs % len(self.ids)]] // len(self.ids))

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """Items whose impacts over the terms sum to 1 or more, by block-max WAND."""
        lists = [(self.postings[t], self.blocks[t], self.most[t]) for t in terms if t in self.postings]
        at = [0] * len(lists)
        out, end = [], len(self.ids)
        current = [p[0][0] for p, _, _ in lists]

        def advance(c: int, item: int) -> None:
            posts, k = lists[c][0], at[c]
            while k < len(posts) and posts[k][0] < item:
                k += 1
            at[c], current[c] = k, posts[k][0] if k < len(posts) else end

        while True:
            order = sorted(range(len(lists)), key=current.__getitem__)
            bound, pivot = 0.0, end
            for n, c in enumerate(order):
                if current[c] == end:
                    break
                bound += lists[c][2]
                if bound >= 1:
                    pivot = current[c]
                    break
            if pivot == end:
                return out
            upto = [c for c in order if current[c] <= pivot]
            block_bound, stop = 0.0, end
            for c in upto:
                posts, maxima, _ = lists[c]
                k = at[c]
                while k < len(posts) and posts[k][0] < pivot:     # the block that may hold the pivot
                    k += 1
                if k < len(posts):
                    b = k // BLOCK
                    block_bound += maxima[b]
                    stop = min(stop, posts[min(len(posts), (b + 1) * BLOCK) - 1][0] + 1)
            if block_bound >= 1:
                for c in upto:
                    advance(c, pivot)
                score = sum(lists[c][0][at[c]][1] for c in upto if current[c] == pivot)
                if score >= 1:
                    out.append((pivot, score))
                for c in upto:
                    advance(c, pivot + 1)
            else:
                after = min((current[c] for c in order if current[c] > pivot), default=end)
                to = max(pivot + 1, min(stop, after))
                for c in upto:
                    advance(c, to)

    def verify(self, item: int, words: list[str]) -> tuple[float, float, float, int]:
        """Overlap of the passage with the item, its question and its answer; first word met."""
        there = shingled(words)
        whole = shingled(self.words[item])
        question, answer = self.parts[item]
        asked, told = shingled(question), set(answer)
        near = [k for k in range(len(words)) if tuple(words[k:k + min(WORDS, len(self.words[item]))]) in whole]
        return (_share(whole, there if len(self.words[item]) >= WORDS else _runs(words, len(self.words[item]))),
                _share(asked, there if len(question) >= WORDS else _runs(words, len(question))),
                _share(told, set(words)), near[0] if near else 0)


def _runs(words: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if width else set()


def _share(wanted: set, there: set) -> float:
    return len(wanted & there) / len(wanted) if wanted else 0.0


def _matches(index: Index, overlap: float, answer_overlap: float):
    stride = index.length

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = arrays.encoded(batch["text"])
            ids = batch["doc_id"].tolist()
            found = []
            for lo, hi in _cuts(texts):
                words, counts = arrays.word_hashes(texts[lo:hi], lower=True)
                ends = np.cumsum(counts)
                own = np.arange(len(words)) - np.repeat(ends - counts, counts)
                base = np.concatenate(([0], np.cumsum(counts // stride + 1)))
                last = np.repeat(base[:-1], counts) + own // stride
                places = np.stack((last, np.where(own >= stride, last - 1, -1)), axis=1)
                met = index.reachable(words, places)
                doc_of = np.searchsorted(base, met, side="right") - 1
                best: dict[tuple[int, int], tuple] = {}
                held, held_words = -1, []
                for place, k in zip(met.tolist(), doc_of.tolist()):
                    if k != held:
                        held = k
                        held_words = split_words(texts[lo + k].decode("utf-8", "surrogatepass"))
                    first = (place - int(base[k])) * stride
                    passage = held_words[first:first + 2 * stride]
                    for item, score in index.search(set(passage)):
                        whole, question, answer, near = index.verify(item, passage)
                        if whole >= overlap and answer >= answer_overlap:
                            row = (whole, score, question, answer, -first - near)
                            if row > best.get((k, item), (-1,)):
                                best[(k, item)] = row
                found += [(ids[lo + k], index.ids[i], s, w, q, a, -f)
                          for (k, i), (w, s, q, a, f) in best.items()]
            out = pd.DataFrame(found, columns=["doc_id", "item_id", "score", "overlap",
                                               "question_overlap", "answer_overlap", "first_word"])
            out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64") if len(out) else out["doc_id"]
            yield out
    return rows


def _cuts(texts: list[bytes], most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", overlap: float = OVERLAP,
               answer_overlap: float = ANSWER_OVERLAP, max_items: int = MAX_ITEMS) -> DataFrame:
    """One row per document and test item it holds: the best passage's score and overlaps.

    A document holds an item if `overlap` of the item's 5-word shingles and `answer_overlap` of the
    words of its answer are in one passage; an item that ends in fewer than 5 words has no answer of
    its own and is judged as a whole. Passages are twice as long as the longest item and
    overlap by half, so no occurrence is cut. score is the BM25 sum over the item's threshold.

    Items without words and items with NULL text are never found. NULL or empty documents hold
    nothing. Repeated documents are found each, repeated items by each id. Rows with a NULL id are
    reported with that NULL. Extra columns are ignored. More than `max_items` items are indexed in
    parts of about that size, one pass over the documents each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    listed = items.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("text"))
    parts = max(1, -(-listed.count() // max_items))
    out = None
    for part in range(parts):
        own = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        own = sorted((r.item_id is None, r.item_id or 0, r.text, r.item_id) for r in own)
        own = [(i, t) for _, _, t, i in own if split_words(t)]
        if own:
            met = rows.mapInPandas(_matches(Index(own, overlap), overlap, answer_overlap), RESULT)
            out = met if out is None else out.union(met)
    return out if out is not None else spark.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that hold no test item. Rows with a NULL id cannot be named and stay."""
    leaks = find_leaks(docs, items, doc_id, **how).select(
        F.col("doc_id").alias(doc_id)).filter(F.col(doc_id).isNotNull()).distinct()
    return docs.join(leaks, doc_id, "left_anti")
