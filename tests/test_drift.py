import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from diamondlake.functions import scalars as S
from diamondlake.operators import drift


def two(spark, base, cur, name="f"):
    rows = [(name, False, float(v)) for v in base] + [(name, True, float(v)) for v in cur]
    return spark.createDataFrame(rows, "feature string, is_current boolean, value double")


def psi_of(spark, base, cur):
    return drift.psi(two(spark, base, cur)).first()["psi"]


def plain_psi(base, cur, bins=10):
    """The definition, on arrays."""
    both = np.concatenate([base, cur])
    edges = np.unique(np.round(np.quantile(both, np.linspace(0, 1, bins + 1)), 9))
    k = len(edges) - 1
    b = np.clip(np.searchsorted(edges, base, "right"), 1, k)
    c = np.clip(np.searchsorted(edges, cur, "right"), 1, k)
    nb = np.bincount(b, minlength=k + 1)[1:] + 0.5
    nc = np.bincount(c, minlength=k + 1)[1:] + 0.5
    pb, pc = nb / nb.sum(), nc / nc.sum()
    return float(((pc - pb) * np.log(pc / pb)).sum())


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_identical_samples(spark, rng):
    x = rng.normal(size=1000)
    assert psi_of(spark, x, x) == 0.0


def test_shift_is_seen_and_symmetric(spark, rng):
    a, b = rng.normal(0, 0.5, 500), rng.normal(3, 0.5, 500)
    one, other = psi_of(spark, a, b), psi_of(spark, b, a)
    assert one > 0.10 and abs(one - other) < 0.1 * one
    assert one == pytest.approx(plain_psi(a, b), abs=1e-6)


def test_never_negative_and_matches_definition(spark, rng):
    for n in (30, 77):
        a, b = rng.normal(size=n), rng.normal(size=n * 2)
        got = psi_of(spark, a, b)
        assert got >= 0 and got == pytest.approx(plain_psi(a, b), abs=1e-6)


def test_discrete_values(spark, rng):
    a, b = rng.integers(0, 4, 300), rng.integers(0, 5, 200)
    assert psi_of(spark, a, b) == pytest.approx(plain_psi(a, b), abs=1e-6)


def test_constant_and_one_sided(spark):
    assert psi_of(spark, [2.0] * 50, [2.0] * 50) == 0.0
    assert psi_of(spark, [1.0, 2.0], []) == 0.0


def test_outlier_does_not_alarm(spark, rng):
    a = rng.uniform(0.45, 0.55, 300)
    b = np.append(rng.uniform(0.45, 0.55, 299), 0.95)
    assert psi_of(spark, a, b) < 0.10


def test_status_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (0.099, 0.10, 0.249, 0.25)], "x double")
    got = [r["s"] for r in df.select(S.psi_status("x").alias("s")).collect()]
    assert got == ["OK", "WARN", "WARN", "ALERT"]


def test_noise_floor(spark):
    df = spark.createDataFrame([(150, 110), (0, 100)], "b int, c int")
    got = [r["f"] for r in df.select(S.psi_noise_floor("b", "c").alias("f")).collect()]
    assert got == [pytest.approx(4.5 * (1 / 150 + 1 / 110)), 0.0]


def frame(spark, columns):
    n = max(len(v) for v in columns.values())
    rows = [tuple(float(v[i]) if i < len(v) else None for v in columns.values())
            for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


def test_location_gate_and_small_windows(spark, rng):
    base = frame(spark, {"moved": rng.normal(0, 1, 400), "same": rng.normal(0, 1, 400),
                         "wider": rng.normal(0, 1, 400), "few": rng.normal(0, 1, 50)})
    wide = rng.normal(0, 6, 200)
    cur = frame(spark, {"moved": rng.normal(2, 1, 200), "same": rng.normal(0, 1, 200),
                        "wider": wide - wide.mean(), "few": rng.normal(9, 1, 20)})
    got = {r["feature"]: r for r in drift.feature_drift(
        base, cur, ["moved", "same", "wider", "few", "absent"]).collect()}
    assert set(got) == {"moved", "same", "wider", "few"}
    assert got["moved"]["status"] == "ALERT" and got["moved"]["location_shift"]
    assert got["same"]["status"] == "OK"
    assert got["wider"]["psi_adjusted"] > 0.25 and got["wider"]["status"] == "OK"
    assert got["few"]["status"] == "INSUFFICIENT"
    assert (got["few"]["n_baseline"], got["few"]["n_current"]) == (50, 20)
    summary = drift.drift_summary(drift.feature_drift(base, cur, ["moved", "same"])).first()
    assert (summary["warnings"], summary["alerts"], summary["features"]) == (0, 1, ["moved"])


def test_quantiles_match_numpy(spark, rng):
    probs = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    data = {"a": rng.normal(size=777), "b": rng.integers(0, 3, 50).astype(float),
            "c": np.array([4.0]), "skewed": np.append(np.full(700, 1.0), rng.normal(size=99))}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    got = drift.exact_quantiles(spark.createDataFrame(rows, "feature string, value double"), probs)
    for r in got.collect():
        assert r["n"] == len(data[r["feature"]])
        assert r["quantiles"] == pytest.approx(list(np.quantile(data[r["feature"]], probs)))
    assert got.count() == 4


def test_medians_of_missing_columns_are_zero(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, 5.0, None), (None, 7.0, None)],
                               "x double, y double, z double")
    got = {r["feature"]: r["median"] for r in drift.medians(df, ["x", "y", "z"]).collect()}
    assert got == {"x": 2.0, "y": 6.0, "z": 0.0}


def test_windows_take_last_days_and_newest_before(spark):
    day = dt.date(2026, 8, 1)
    rows = [(i, day + dt.timedelta(days=i // 10), 1.0 if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "game_pk int, game_date date, home_win double")
    target = day + dt.timedelta(days=59)
    base, cur = drift.drift_windows(df, target)
    n = cur.count()
    assert n == sum(1 for r in rows if r[2] and r[1] >= target - dt.timedelta(days=7))
    assert base.count() == max(3 * n, 250)
    assert base.agg(F.max("game_date")).first()[0] < target - dt.timedelta(days=7)


def test_coverage(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0)], "a double, b double")
    got = {r["feature"]: r["coverage_pct"] for r in
           drift.feature_coverage(df, ["a", "b", "zz"]).collect()}
    assert got == {"a": 67.0, "b": 33.0}


def test_newest_rows_ranks_text_ids_in_their_order(spark):
    rows = [(f"g{i:05d}", dt.date(2026, 5, 1)) for i in range(2000)] + [("old", dt.date(2026, 4, 1))]
    df = spark.createDataFrame(rows, "game_pk string, game_date date")
    got = sorted(r["game_pk"] for r in drift.newest_rows(df, 250).collect())
    assert got == [f"g{i:05d}" for i in range(1750, 2000)]
    assert drift.newest_rows(df, 2001).count() == 2001 and drift.newest_rows(df, 9999).count() == 2001
