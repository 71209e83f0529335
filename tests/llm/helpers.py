"""Small corpora and brute-force versions of the text operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def corpus(seed=3, n=60):
    """(doc_id, text): random prose with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = prose(70)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(texts) < 3:
            w = prose(rng.randint(80, 300))
        elif kind == 1:
            w = rng.choice(texts).split(" ")                        # exact copy
        elif kind == 2:
            w = list(rng.choice(texts).split(" "))                  # a few words changed
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "CHANGED"
        elif kind == 3:
            w = prose(40) + shared[rng.randint(0, 10):] + prose(30)
        elif kind == 4:
            w = prose(20) + shared[:60] + prose(5) + shared[:60]    # twice in one document
        else:
            w = prose(rng.randint(0, 6))
        texts.append(" ".join(w))
    texts += ["", "a\x0bb\tc\n\nd", "x" * 3000, ("ab " * 400), "NUL\x00 here there"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(1000, None)]


def frame(spark, rows, *extra):
    """Rows as documents with clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, high long"
    return spark.createDataFrame(
        [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), -1, "no", 5) for i, t in rows], schema)


EMPTY = "doc_id long, text string, source string, size long"
