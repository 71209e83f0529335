import datetime as dt

import pytest

from diamondlake.sources import profile as P

SCHEMA = ("tiny int, small long, wide long, edge long, low long, none int, price double, kind string, name string, "
          "empty string, day date, tags array<int>")


def rows(n=300):
    return [(k % 100, 32_767 - k, 40_000 * k, 32_768 - k % 2, -129 + k, None, float("nan") if k % 7 == 0 else k / 4,
             None if k % 5 == 0 else "abc"[k % 3], f"n{k}", None, dt.date(2025, 1, 1), [k]) for k in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def test_profile_counts_and_ranges(frame):
    got = {r["column"]: r for r in P.profile(frame).collect()}
    assert "tags" not in got and [got[c]["position"] for c in ("tiny", "day")] == [0, 10]
    assert (got["wide"]["least"], got["wide"]["greatest"]) == (0, 40_000 * 299)
    assert got["none"]["n_null"] == 300 and got["none"]["least"] is None
    assert got["price"]["n_null"] == sum(k % 7 == 0 for k in range(300))
    assert got["kind"]["n_null"] == 60 and got["kind"]["n_distinct"] == 3


def test_types_by_range(frame):
    got = {r["column"]: r["chosen"] for r in P.chosen(frame).collect()}
    assert got == {"tiny": "tinyint", "small": "smallint", "wide": "int", "edge": "int", "low": "smallint",
                   "none": "tinyint", "price": "float", "kind": "category", "name": "string", "empty": "category",
                   "day": "date"}


@pytest.mark.parametrize("n, kind", [(99, "category"), (100, "string"), (101, "string")])
def test_category_limit_is_exact(spark, n, kind):
    df = spark.createDataFrame([(f"v{k % n}",) for k in range(5 * n)], "c string")
    assert P.chosen(df).first()["chosen"] == kind


def test_narrow_table_gives_back_its_values(spark, frame):
    small, codes = P.narrow(frame)
    types = dict(small.dtypes)
    assert types["kind"] == "tinyint" and types["small"] == "smallint" and types["tags"] == "array<int>"
    assert [(r["code"], r["value"]) for r in codes.filter("column = 'kind'").orderBy("code").collect()] == [
        (0, "a"), (1, "b"), (2, "c")]
    back = small.join(codes.filter("column = 'kind'"), small["kind"] == codes["code"], "left")
    assert sorted((r["name"], r["value"]) for r in back.collect() if r["value"]) == sorted(
        (r[8], r[7]) for r in rows() if r[7])
    assert small.agg({"wide": "sum"}).first()[0] == sum(r[2] for r in rows())


def test_empty_table_and_table_without_plain_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert {r["n_rows"] for r in P.profile(empty).collect()} == {0}
    small, codes = P.narrow(empty)
    assert small.count() == 0 and codes.count() == 0
    assert P.chosen(spark.createDataFrame([([1],)], "a array<int>")).count() == 0


def test_one_scan_of_the_table(spark):
    plan = P.profile(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
