import random
import re
import zlib
from collections import Counter

import pytest

from diamondlake.llm.spelling import SYMBOLS, count_words, group_variants, near_pairs, spelling_variants
from tests.llm.helpers import EMPTY, FOLD, frame


def edits(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, factor=2):
    forms, out = {}, []
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * n else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        f = forms[w]
        out.append((w, f, root, n, len(near[w]), None if f is None else counts[f]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, n=500, letters="abcdeléÿ"):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        words.add("".join(rng.choice(letters) for _ in range(rng.randint(5, 7))))
    return {w: int(3 * 2 ** (rng.random() * 9)) for w in sorted(words)}


@pytest.mark.parametrize("symbols", [SYMBOLS, "ab", "abcd"])
def test_variants_against_brute_force(spark, symbols):
    counts = made(len(symbols))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(group_variants(df, symbols=symbols)) == brute(counts)


def test_words_of_any_code_points(spark):
    counts = {"naïve": 9, "naive": 40, "日本語文字": 8, "日本語文": 3, "\U0001F600bcde": 5, "\U0001F601bcde": 10,
              "bcde": 10, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "x" * 300: 3, "x" * 301: 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(group_variants(df)) == brute(counts)
    ties = {"baaaa": 8, "caaaa": 8, "aaaaa": 4, "zzzzz": 3}
    assert got(group_variants(spark.createDataFrame(list(ties.items()), "word string, n long"))) == brute(ties)


def test_every_pair_once(spark):
    counts = made(9, 120, "ab")
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [frozenset((r.a, r.b)) for r in near_pairs(df, "ab").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in counts for b in counts if a < b and edits(a, b)}


def planted(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_documents(spark):
    rng = random.Random(4)
    pool = ["Straße", "ÉCOLE", "école", "lignes", "Ligne", "ligns", "words", "Wordy", "a", "it's", "x2y", "größer",
            "grosser", "naïveté", "naivete", "÷×÷×÷×", "ZÜRICH", "zürich"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(200))) for i in range(60)]
    rows += [(900, None), (901, ""), (None, "words words words lignes"), (902, "words" * 4000), (0, rows[0][1])]
    counts = planted(rows)
    assert any(w not in {p.translate(FOLD) for p in pool} for w in counts)      # some letters were taken out
    docs = frame(spark, rows)
    assert {r.word: r.n for r in count_words(docs, typo_every=97).collect()} == counts
    assert got(spelling_variants(docs, typo_every=97)) == brute(counts)


def test_no_words(spark):
    assert spelling_variants(spark.createDataFrame([], EMPTY)).count() == 0
    assert spelling_variants(frame(spark, [(1, "to be or"), (2, None)])).count() == 0
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([], "word string, n long"), factor=1)
