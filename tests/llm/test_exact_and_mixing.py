import math
from collections import Counter, defaultdict

import pytest

from diamondlake.llm.exact_dedup import exact_dedup
from diamondlake.llm.mixing import emitted, mix
from tests.llm.helpers import EMPTY, corpus, frame, sha, words


def test_exact_dedup_against_brute_force(spark):
    rows = corpus() + [(2000, "same head " * 9 + "x"), (2001, "same head " * 9 + "y"), (2002, ""), (2003, "é"),
                       (2004, "é")]
    got = {r.doc_id: r for r in exact_dedup(frame(spark, rows), digest_all=True).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), sha(text))


def test_exact_dedup_reads_only_groups_of_one_length_and_prefix(spark):
    rows = [(1, "alpha"), (2, "gamma"), (3, "alpha"), (4, "long one here")]
    got = {r.doc_id: r.text_sha256 for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: sha("alpha"), 2: None, 3: sha("alpha"), 4: None}


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    rows = [(None, "t"), (1, "t"), (None, "u"), (None, "u"), (5, "v"), (5, "v")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows)).collect())
    assert got == Counter({(None, 1, 2, False): 1, (1, 1, 2, True): 1, (None, None, 2, True): 2, (5, 5, 2, True): 2})
    assert exact_dedup(spark.createDataFrame([], EMPTY)).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    """Share all sizes by weight, again and again, until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in fixed)
        share = sum(weight[s] for s in names if s not in fixed)
        target = {s: most * sizes[s] if s in fixed else rest * weight[s] / share for s in names}
        above = {s for s in names if target[s] > most * sizes[s] + 1e-9} - fixed
        if not above:
            return target
        fixed |= above


def test_mix_reaches_targets_and_is_repeatable(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), ["b", "a", None, "Z", "é", "tiny"][0 if i % 3 else i // 3 % 6])
            for i in range(3000)] + [(9001, None, "empty"), (9002, "", "empty"), (9003, "one", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in rows}
    size = {i: len(words(t)) for i, t, _ in rows}
    for i, _, s in rows:
        sizes[s] += size[i]
    want = water(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.taken == r.copies * r.size
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert math.floor(rate) <= r.copies <= min(3, math.floor(rate) + 1)
        taken[s] += r.taken
    for s in sizes:
        if sizes[s] > 1000:
            assert taken[s] == pytest.approx(want[s], rel=0.12)
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_emits_copies_and_takes_odd_rows(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (3, "c", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rate")
    mixed = mix(docs, keep=["source"])
    assert mixed.count() == 4
    out = emitted(mixed)
    assert out.count() == sum(r.copies for r in mixed.collect())
    assert {r["copy"] for r in out.collect()} <= {1, 2, 3}
    assert mix(spark.createDataFrame([], EMPTY)).count() == 0


def test_rows_without_an_id_are_spread(spark):
    from diamondlake.llm.shards import sharded
    docs = frame(spark, [(None, f"text number {k} of many") for k in range(400)])
    dealt = sharded(docs, "doc_id", "text", 100)
    assert dealt.n > 50 and dealt.docs.select("shard").distinct().count() > dealt.n / 2
    assert dealt.docs.filter("not has_id").count() == 400
    out = exact_dedup(docs).collect()
    assert len(out) == 400 and all(r.group_size == 1 and r.kept and r.keep_id is None for r in out)
