import hashlib
import random

import numpy as np
import pytest

from diamondlake.llm import clustering
from diamondlake.llm.clustering import cluster_vectors, dots, nearest, pack, squares, unpack

SCHEMA = "vec_id long, embedding array<float>, cluster string, planes int, label int"


def brute(rows, k=40, rounds=5):
    """Plain k-means on whole numbers."""
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [list(v) for _, v in order[:k]]

    def place():
        out = []
        for _, v in good:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = place()
        for c in range(len(cent)):
            mine = [v for (_, v), (x, _) in zip(good, at) if x == c]
            if mine:
                cent[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = place()
    total = [sum(d for c, d in at if c == x) for x in range(len(cent))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, total[c], sum(total), digest[c]) for (i, _), (c, d) in zip(good, at)), key=str)


def made(seed, n, spread=0.3):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(heads)]) for i in rng.sample(range(9 * n), n)]


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in cluster_vectors(df, **options).collect()), key=str)


def test_planes_give_exact_products():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 9, 28):
        high = 1 << bits - 1
        a, b = (rng.integers(-high, high, (50, 64)) for _ in range(2))
        a[0], b[0] = -high, high - 1
        assert (unpack(pack(a, bits)) == a).all()
        assert (dots(pack(a, bits), pack(b, bits)) == a @ b.T).all()
        assert (squares(pack(a, bits)) == (a * a).sum(axis=1)).all()
        label, distance = nearest(pack(a, bits), pack(b, bits))
        want = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
        assert (label == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_clusters_against_brute_force(spark, monkeypatch):
    rows = made(1, 400)
    rows += [(90000 + i, rows[0][1]) for i in range(150)]                  # a hot vector, ties between centroids
    rows += [(rows[3][0], rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    odd = [(80001, None), (80002, []), (80003, [0.5] * 63), (80004, [0.5] * 65), (80005, [0.5] * 63 + [None]),
           (80006, [float("nan")] + [0.5] * 63), (80007, [float("-inf")] + [0.5] * 63)]
    want = brute(rows + odd)
    assert got(spark, rows + odd) == want
    monkeypatch.setattr(clustering, "SLICE", 7)
    assert got(spark, rows, k=12, rounds=2) == brute(rows, 12, 2)


def test_small_and_empty_tables(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [1.0] * 64)]
    assert got(spark, rows) == brute(rows)
    assert len({r[1] for r in got(spark, rows)}) == 2       # of equal centroids the smaller number takes all
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == []
    zeros = [(i, [-0.0] * 64) for i in range(5)]
    assert got(spark, zeros) == brute(zeros)


def test_numbers_too_large_for_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        got(spark, [(1, [1e30] * 64)])
