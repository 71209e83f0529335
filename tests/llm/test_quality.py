import math
import random
import re
import zlib

from diamondlake.llm import quality

LABELS = "doc_id long, quality int, doc_quality string"


def made(n=400):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [word() for _ in range(rng.randint(20, 120))]
        text = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "en"))
        labels.append((i, int(good), "x"))
    return rows, labels


def test_held_out_accuracy_and_one_expression(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    assert 0 < len(model.weights) < 60
    out = quality.score(docs.drop("score"), model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    truth = dict((i, q) for i, q, _ in labels)
    right = [r.predicted == truth[r.doc_id] for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(right) > 60 and sum(right) / len(right) > 0.97


def test_held_out_labels_are_never_read(spark):
    rows, labels = made(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, x) for i, q, x in labels]
    a = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    b = quality.fit(docs, spark.createDataFrame(flipped, LABELS))
    assert a == b


def test_odd_rows_and_missing_labels(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    for labels, share in (([], 0.5), ([(1, 1, "a"), (1, 1, "b")], 0.75), ([(7, 0, ""), (None, 1, ""), (1, None, "")], 0.5)):
        model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
        got = quality.score(docs, model).collect()
        assert len(got) == 4 and all(abs(r.score - share) < 1e-6 for r in got) or labels and len(got) == 4
    model = quality.RuleModel(0.1, {quality.Rule((("shouts", True, 0.5), ("words", False, 9.0))): -3.0})
    got = quality.score(spark.createDataFrame([(1, "A!! B!!"), (2, "A b"), (3, None)], "doc_id long, text string"), model)
    assert [round(r.score, 3) for r in got.orderBy("doc_id").collect()] == [0.052, 0.525, 0.525]
    assert quality.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_the_model_does_not_depend_on_the_partitions(spark):
    rows, labels = made(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    given = spark.createDataFrame(labels, LABELS)
    models = [quality.fit(docs.repartition(n, "text"), given.repartition(n)) for n in (2, 8, 32)]
    assert models[0] == models[1] == models[2] and models[0].weights


def test_statistics_and_scores_against_brute_force(spark):
    texts = ["", None, "Two words.", "A, b; c: D!! | # x\n\nÉ 7 7 7", "w " * 3000, "\x00 nul\x0bvt", "ends?\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.with_statistics(docs).collect()}
    caps = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ"
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        k, n = max(len(words), 1), max(len(t), 1)
        rate = lambda chars, of: sum(c in chars for c in t) / of  # noqa: E731, B023
        want = {"words": min(k, 2000), "word_length": len(t) / k, "distinct": len(set(words)) / k,
                "capitals": rate(caps, n), "digits": rate("0123456789", n), "stops": rate(".?", k),
                "commas": rate(",;:", k), "shouts": rate("!", k), "bars": rate("|", k),
                "marks": rate(quality.MARKS, k), "lines": rate("\n", k)}
        for name, value in want.items():
            assert abs(rows[i][f"_s_{name}"] - value) < 1e-12, (i, name)
    rules = {quality.Rule((("digits", True, 0.05), ("words", False, 9.0))): 2.0,
             quality.Rule((("distinct", False, 0.5),)): -1.5}
    for r in quality.score(docs, quality.RuleModel(0.25, rules)).collect():
        s = rows[r.doc_id]
        total = 0.25 + 2.0 * (s._s_digits > 0.05 and s._s_words <= 9) - 1.5 * (s._s_distinct <= 0.5)
        p = 1 / (1 + math.exp(-total))
        assert abs(r.score - p) < 1e-12 and r.predicted == int(p >= 0.7)
