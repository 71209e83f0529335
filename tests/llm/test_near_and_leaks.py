import random

import pytest

from diamondlake.llm import components as components_
from diamondlake.llm import decontaminate, near_dedup
from diamondlake.session import Stage
from tests.llm.helpers import EMPTY, FOLD, corpus, frame, words


def shingles(text, width=5):
    w = words((text or "").translate(FOLD))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(n=330, seed=4):
    """One text and many variants of it, more than a region holds, and a chain of small changes."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(120)]
    for i in range(12):
        rows.append((500 - i, " ".join(chain[i * 6:i * 6 + 60])))
    return rows


@pytest.mark.parametrize("rows", [corpus(), family()], ids=["corpus", "family"])
def test_near_dedup_against_brute_force(spark, rows):
    want = components(rows)
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_settled_links_are_not_read_again(spark, monkeypatch):
    """Links found later are drawn between components; before, every pass read all earlier links once a round."""
    edges, put = {}, Stage.put

    def noted(self, name, df):
        out = put(self, name, df)
        if name.endswith("-edges"):
            edges[name] = out.count()
        return out
    monkeypatch.setattr(Stage, "put", noted)
    rows = family()
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in components(rows).items()}
    assert edges["all-edges"] < edges["first-edges"] / 10


def test_components_extended_by_further_links(spark):
    stage = Stage(spark)
    frame_of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first = components_.connected_components(frame_of([(1, 2), (2, 3), (10, 11), (20, 21)]), stage, "a")
    out = components_.extended_components(first, frame_of([(3, 11), (0, 21), (30, 31), (5, 5), (2, 1)]), stage, "b")
    assert {r.id: r.component for r in out.collect()} == {
        1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 0: 0, 20: 0, 21: 0, 30: 30, 31: 30}
    none = components_.extended_components(first, frame_of([]), stage, "c")
    assert {r.id: r.component for r in none.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (4, "a b c d e f"), (5, ""), (6, None),
            (7, "one"), (8, "ONE"), (8, "one two"), (9, "one two")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept)
                 for r in near_dedup.near_dedup(frame(spark, rows)).collect())
    assert got == [(0, 2, 0, True), (0, 2, 0, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (6, 0, 6, True),
                   (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False), (9, 1, 7, False)]
    assert near_dedup.near_dedup(spark.createDataFrame([], EMPTY)).count() == 0


def bench(seed=8, n=25):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    sentence = lambda: " ".join(rng.choice(common) if rng.random() < .4 else f"r{rng.randrange(600)}"
                                for _ in range(rng.randint(6, 20))) + "."
    return [(i, " ".join(sentence() for _ in range(rng.randint(1, 4)))) for i in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = bench() + [(100, None), (101, ""), (102, "two words"), (None, "null id item with seven words here")]
    filler = lambda k: " ".join(f"r{rng.randrange(600)}" if rng.random() < .5 else f"c{rng.randrange(12)}"
                                for _ in range(k))
    rows = []
    for i in range(150):
        item = rng.choice(items[:25])[1].split(" ")
        if i % 3 == 0:
            item = item[:int(len(item) * rng.uniform(.3, 1))]
        elif i % 3 == 1:
            item[rng.randrange(len(item))] = "changed"
        rows.append((i, filler(rng.randint(0, 300)) + " " + " ".join(item).upper() + " " + filler(rng.randint(0, 200))))
    rows += [(900, None), (901, ""), (902, filler(60_000) + " " + items[3][1] + " " + filler(10)), (903, "say two words now")]
    docs, tests = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in rows:
        w = words((text or "").translate(FOLD))
        for i, t in items:
            item = shingles(t)
            length = len(words(t))
            here = shingles(text) if length >= 5 else {tuple(w[k:k + length]) for k in range(len(w) - length + 1)}
            if item and len(item & here) >= .75 * len(item):
                answer = set(decontaminate.question_and_answer(t.translate(FOLD))[1])
                if len(answer & set(w)) >= .5 * len(answer):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, tests).collect()}
    assert got == want and len(want) > 40
    parts = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, tests, max_items=7).collect()}
    assert parts == want
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, tests).collect()}
    assert clean == {i for i, _ in rows} - {d for d, _ in want}


def test_a_changed_last_word_does_not_hide_a_copy(spark):
    body = "What is the largest number of edges that a graph of n nodes and no triangle can have at most?"
    items = [(1, body + " N."), (2, body.upper().replace("GRAPH", "forest") + " It is n less one of course.")]
    docs = frame(spark, [(1, f"so {body} N."), (2, f"so {body} M."), (3, f"so {body} N and on"), (4, body), (5, "N. N.")])
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, tests).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert decontaminate.question_and_answer("a b c d e? f g h i j.") == (list("abcd") + ["e?"], list("fghi") + ["j."])


def test_block_max_wand_equals_full_scoring():
    index = decontaminate.Index(bench(5, 60))
    rng = random.Random(1)
    for _ in range(300):
        base = rng.choice(index.words)
        terms = {w for w in base if rng.random() < rng.choice((.5, .9))} | {f"r{rng.randrange(600)}" for _ in range(30)}
        full = {}
        for t in terms:
            for i, s in index.postings.get(t, ()):
                full[i] = full.get(i, 0) + s
        want = {i: s for i, s in full.items() if s >= 1}
        got = dict(index.search(terms))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_leaks_empty_tables(spark):
    docs = frame(spark, [(1, "a b c"), (None, "a b c"), (1, "a b c")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    one = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(docs, one).collect()) == [(0, 7), (1, 7), (1, 7)]
    assert decontaminate.find_leaks(spark.createDataFrame([], EMPTY), one).count() == 0


def crowd(seed=6, n=420):
    """A passage that all share (about half of each text), pairs and triples of near copies among them, chains
    from one to another, and a group of copies of one text with outsiders just above and below the limit."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows, fresh = [], lambda k: [f"u{rng.randrange(10 ** 9)}" for _ in range(k)]
    while len(rows) < n:
        own = fresh(rng.randint(40, 70))
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            w = list(own)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = fresh(1)[0]
            rows.append((len(rows), " ".join(passage + w)))
    base = passage + fresh(60)
    for k in range(300):
        w = list(base)
        w[60 + k % 60] = f"v{k}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(60):                            # one word longer or shorter around the limit
        rows.append((5000 + k, " ".join(base[:104 - k % 20] + fresh(12))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sorted_", [near_dedup.SORTED, 50])
def test_crowded_regions_lose_no_link(spark, monkeypatch, sorted_):
    monkeypatch.setattr(near_dedup, "REGION", 16)
    monkeypatch.setattr(near_dedup, "SORTED", sorted_)
    monkeypatch.setattr(near_dedup, "ROWS", sorted_ // 2)
    rows = crowd()
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == want
    assert len(set(c for _, c in want.values())) > 100


def test_briefs_count_equal_values(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    signs = rng.integers(-2 ** 31, 2 ** 31, (200, near_dedup.VALUES)).astype(np.int32)
    for i in range(100):
        keep = rng.random(near_dedup.VALUES) < i / 100
        signs[100 + i, keep] = signs[i, keep]
    brief = near_dedup._brief(signs)
    rows = spark.createDataFrame([(i, brief[i].tolist(), brief[100 + i].tolist()) for i in range(100)],
                                 "i int, a array<long>, b array<long>")
    got = {r.i: r.like for r in rows.select("i", near_dedup._alike(rows.a, rows.b).alias("like")).collect()}
    for i in range(100):
        same = ((signs[i] & 15) == (signs[100 + i] & 15)).sum()
        assert got[i] == (same >= int(near_dedup.LIKELY * near_dedup.VALUES))
