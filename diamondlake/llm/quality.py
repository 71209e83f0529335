"""Document quality by a sparse rule ensemble.

1. Statistics of every text are Spark column expressions.
2. A forest of shallow trees is fitted on a bounded sample of labelled documents; every path from
   a root to a node is a conjunctive rule over the statistics.
3. A lasso logistic regression over the rules (0 or 1) keeps few of them.
4. The kept rules are compiled into one column expression, so that scoring is a projection: no
   join, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlake.llm.common import text_of
from diamondlake.session import Stage

SAMPLE = 20_000         # labelled documents that a fit reads at most, lowest hash of the id first
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 7
THRESHOLD = 0.7
HELD_OUT = 2            # remainder of crc32(doc_id as text) modulo 4 that is never learnt from
MARKS = "#$%&*@^~=+<>{}[]\\/_"


def _count(chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.length("_text") - F.length(F.translate("_text", chars, ""))


def statistics() -> dict[str, Column]:
    """Name and expression of each statistic, over the columns _text and _words.

    All are rates or bounded sizes; an empty text has 0 in each.
    """
    n = F.greatest(F.length("_text"), F.lit(1)).cast("double")
    words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    caps = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ"
    return {
        "words": F.least(words, F.lit(2000.0)),
        "word_length": F.length("_text") / words,
        "distinct": F.size(F.array_distinct("_words")) / words,
        "capitals": _count(caps) / n,
        "digits": _count("0123456789") / n,
        "stops": _count(".?") / words,
        "commas": _count(",;:") / words,
        "shouts": _count("!") / words,
        "bars": _count("|") / words,
        "marks": _count(MARKS) / words,
        "lines": _count("\n") / words,
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with one double column _s_<name> for each statistic."""
    out = docs.withColumn("_text", text_of(text)).withColumn(
        "_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumns({f"_s_{k}": F.coalesce(v.cast("double"), F.lit(0.0))
                           for k, v in statistics().items()})
    return out.drop("_text", "_words")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == HELD_OUT


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, cut); without terms it always holds."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.terms:
            out &= (F.col(f"_s_{name}") > cut) if above else (F.col(f"_s_{name}") <= cut)
        return out


@dataclass
class RuleModel:
    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights.items():
            total += F.when(rule.column(), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def tree_rules(model, names: list[str]) -> list[Rule]:
    """The rules of all nodes below the roots of a fitted forest, bounds of a path merged."""
    found: dict[Rule, None] = {}

    def walk(node, terms: dict[tuple[str, bool], float]) -> None:
        if terms:
            found[Rule(tuple(sorted((n, a, c) for (n, a), c in terms.items())))] = None
        if node.getClass().getSimpleName() == "LeafNode":
            return
        split = node.split()
        name, cut = names[split.featureIndex()], float(split.threshold())
        low, high = terms.get((name, False)), terms.get((name, True))
        walk(node.leftChild(), {**terms, (name, False): cut if low is None else min(low, cut)})
        walk(node.rightChild(), {**terms, (name, True): cut if high is None else max(high, cut)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
        penalty: float = PENALTY) -> RuleModel:
    """Fit the ensemble on at most `sample` labelled documents outside the held-out remainder.

    The sample takes the lowest hashes of the ids, so it does not depend on the order of rows.
    Labels other than 0 and 1, NULL ids and labels without a document are left out; a repeated
    label counts once, contradicting ones both. Without any label, or with one class only, the
    model is the constant share of label 1 (0.5 without labels), kept off 0 and 1.
    """
    stage = Stage(docs.sparkSession)
    known = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
             .filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
             .distinct().orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "_y").limit(sample))
    picked = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_t")).join(
        F.broadcast(stage.put("known", known)), "_id")      # at most `sample` rows
    names = list(statistics())
    # at most `sample` short rows in one partition and one order: sums and draws come out alike every time
    stats = with_statistics(picked, "_t").drop("_t")
    rows = stage.put("rows", stats.repartition(1).sortWithinPartitions(
        F.xxhash64("_id", F.lit(SEED)), *stats.columns).drop("_id")).coalesce(1)
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not total or ones in (0, total):
        share = (ones + 0.5) / (total + 1)
        return RuleModel(_logit(share))
    vectors = VectorAssembler(inputCols=[f"_s_{n}" for n in names], outputCol="_x")
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=depth,
                                    maxBins=64, seed=SEED).fit(vectors.transform(rows))
    rules = tree_rules(forest, names)
    if not rules:
        return RuleModel(_logit(ones / total))
    flags = rows.select("_y", *[r.column().cast("double").alias(f"_r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_x").transform(flags)
    lasso = LogisticRegression(labelCol="_y", featuresCol="_x", elasticNetParam=1.0,
                               regParam=penalty, standardization=False, maxIter=60).fit(
        stage.put("flags", flags.select("_y", "_x")).coalesce(1))
    kept = {r: float(w) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6}
    return RuleModel(float(lasso.intercept), kept)


def _logit(share: float) -> float:
    import math
    return math.log(share / (1 - share))


def score(docs: DataFrame, model: RuleModel, text: str = "text", column: str = "score",
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows with their score (0 to 1, higher: better) and predicted (1 from `threshold`).

    NULL and empty texts get the score of all-zero statistics. Texts are read whole. Repeated
    rows score alike. Columns that begin with _s_, _text or _words must not exist in `docs`.
    """
    out = with_statistics(docs, text).withColumn(column, model.score())
    out = out.withColumn("predicted", (F.col(column) >= threshold).cast("int"))
    return out.drop(*[f"_s_{n}" for n in statistics()])
