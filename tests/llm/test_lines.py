import hashlib
import random
from collections import defaultdict

from diamondlake.llm.line_dedup import drop_repeated_lines
from tests.llm.helpers import EMPTY, FOLD, frame, sha

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least_chars=10, least_docs=2):
    """[(id, n_lines, n_dropped, kept text)] line by line; rows without an id are left alone."""
    key = lambda line: line.strip(WHITE).translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < least_docs or i == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept_sha256 == sha(r.kept) for r in rows)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=str)


def documents(seed, n=120):
    rng = random.Random(seed)
    lines = ["a common line of the site", "  A Common LINE of the site\t", "short", "", "   ", "ÉCOLE des lignes",
             "école des lignes", "0123456789", "012345678", "ends in a separator ", "ends in a separator",
             "x" * 5000, "  tail \x85", "crlf line here\r", "crlf line here", "\x00 zero byte line", "\U0001F600" * 10]
    return [(i, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own line {i} {k}"
                          for k in range(rng.randint(0, 12)))) for i in rng.sample(range(10 * n), n)]


def test_lines_against_brute_force(spark):
    rows = documents(1) + [(5001, None), (5002, ""), (5003, "\n"), (5004, "\n\n"), (5005, "a common line of the site\n")]
    assert got(drop_repeated_lines(frame(spark, rows))) == brute(rows)
    assert got(drop_repeated_lines(frame(spark, rows), least_docs=5, least_chars=4)) == brute(rows, 4, 5)


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(4, "one line of words\nfirst"), (4, "one line of words\nsecond"), (4, "one line of words\nsecond"),
            (2, "another line here"), (2, "another line here"), (3, "another line here\none line of words"),
            (None, "one line of words"), (None, "one line of words"), (None, None)]
    assert got(drop_repeated_lines(frame(spark, rows))) == brute(rows)
    only = [(None, "one line of words"), (7, "one line of words")]
    assert got(drop_repeated_lines(frame(spark, only))) == brute(only)   # an id that nobody has holds nothing
    assert drop_repeated_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_one_line_in_every_document_and_one_very_long_document(spark):
    rows = [(i, f"the notice that everybody carries\nown words {i}") for i in range(2000)]
    rows.append((-1, "\n".join(f"line number {k % 30000:08d}" for k in range(60000))))
    rows.append((9999, "\n".join(f"line number {k:08d}" for k in range(0, 60000, 2))))
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in drop_repeated_lines(frame(spark, rows), keep_text=False).collect()}
    assert out[-1] == (60000, 0) and out[9999] == (30000, 15000)
    assert out[0] == (2, 0) and all(out[i] == (2, 1) for i in range(1, 2000))


def test_no_python_on_the_way(spark):
    plan = drop_repeated_lines(frame(spark, documents(2)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_names_of_columns_are_free(spark):
    docs = frame(spark, [(1, "the same long line"), (2, "the same long line")]).withColumnsRenamed(
        {"doc_id": "lines", "text": "gone"})
    out = drop_repeated_lines(docs, doc_id="lines", text="gone").orderBy("doc_id").collect()
    assert [r.n_dropped for r in out] == [0, 1]
    assert out[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
