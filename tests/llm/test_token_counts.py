import random

import pytest

from diamondlake.llm.token_counts import count_tokens, default_path
from tests.llm.helpers import EMPTY, corpus, frame

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_path())


def fuzz(n=600):
    rng = random.Random(5)
    letters = "aAbBzZ'sStT \n\t\x1c\x85 éÉÈñ中文😀0123ⅣΣσςİſﬁ̈̈́'llVE!?#$\x00​²½ªǅ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["<|startoftext|>x<|endoftext|> y", "<|STARTOFTEXT|>", "x" * 20_000, "aΣ ΑΣ", "", "don't I'LL",
                  "e<|endoftext|>́", "word " * 50_000]


def test_counts_equal_the_library(spark, library):
    texts = fuzz() + [t for _, t in corpus() if t is not None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in count_tokens(frame(spark, rows)).collect()}
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for i, t in rows:
        assert (got[i].n_tokens, got[i].n_bytes) == (want[i], len(t.encode())), repr(t[:80])
        assert got[i].over_limit == (want[i] > 2048)


def test_odd_rows(spark):
    got = count_tokens(frame(spark, [(None, "a"), (None, "a"), (1, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == [(-1, 1, 1), (-1, 1, 1), (1, 0, 0)]
    assert count_tokens(spark.createDataFrame([], EMPTY)).count() == 0
