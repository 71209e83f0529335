import re

import pytest

from diamondlake.llm.repeats import remove_repeats
from diamondlake.llm import shards
from diamondlake.llm.substrings import remove_substrings
from tests.llm.helpers import EMPTY, corpus, frame, sha, words


def word_repeats(rows, window):
    first, want = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return want


def byte_repeats(rows, window):
    seen, want = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k:k + window] in seen:
                gone[k:k + window] = b"\1" * window
            seen.add(b[k:k + window])
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                   sha(bytes(x for x, g in zip(b, gone) if not g)))
    return want


@pytest.fixture
def small_shards(monkeypatch):
    """Many shards and buckets, so that repeats cross them."""
    whole = shards.sharded
    monkeypatch.setattr(shards, "sharded", lambda d, i, t: whole(d, i, t, 4000))


@pytest.mark.parametrize("window", [50, 11])
def test_word_repeats_against_brute_force(spark, small_shards, window):
    rows = corpus()
    want = word_repeats([(i, t or "") for i, t in rows], window)
    got = remove_repeats(frame(spark, rows), window=window).collect()
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 100
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        assert r.kept_sha256 == sha(r.kept)


@pytest.mark.parametrize("window,hot", [(100, 4096), (100, 2), (30, 4096)])
def test_byte_repeats_against_brute_force(spark, small_shards, window, hot):
    rows = corpus()
    want = byte_repeats(rows, window)
    got = remove_substrings(frame(spark, rows), window=window, hot=hot).collect()
    assert len(got) == len(rows) and sum(w[2] for w in want.values()) > 30
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_a_long_text_and_runs_of_one_letter(spark):
    rows = [(1, "a" * 5000), (2, " ".join(f"w{k}" for k in range(300_000))), (3, "b " * 90)]
    rows.append((4, rows[1][1][1000:4000]))
    got = {r.doc_id: r for r in remove_substrings(frame(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [4999, 0, 178, 3000]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows)).collect()}
    assert got[4].n_removed >= got[4].n_words - 2 and got[2].n_removed == got[3].n_removed == 0


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text), (5, text), (5, text), (6, text), (7, None), (8, "")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (5, 0), (5, 0), (6, 60), (7, 0), (8, 0)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_substrings(frame(spark, rows)).collect())
    n = len(text)
    assert got == [(0, 0), (0, 0), (5, 0), (5, n), (6, n), (7, 0), (8, 0)]
    for op in (remove_repeats, remove_substrings):
        assert op(spark.createDataFrame([], EMPTY)).count() == 0
        only_null = op(frame(spark, [(None, None)])).collect()
        assert [(r.doc_id, r.n_removed) for r in only_null] == [(None, 0)]
