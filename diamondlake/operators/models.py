"""Win-probability ensemble on MLlib, its walk-forward evaluation and linear attributions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diamondlake import constants as K
from diamondlake.functions import scalars as S
from diamondlake.operators import boosting, drift, folds, forests, metrics
from diamondlake.session import Stage, ship_package

TASK_ROWS = 250_000           # training rows that one task of the linear member's jobs gets
FOLDS_AT_ONCE = 4             # folds trained side by side by jobs of their own; each holds its rows in the cache

# boosted members are saved as forests; those saved as MLlib models before are read as well
_LOADERS = {"boosted_a": GBTClassificationModel, "boosted_b": GBTClassificationModel,
            "logistic": LogisticRegressionModel}


@dataclass
class Settings:
    """Boosting parameters that both boosted members share.

    They grow by MLlib's rules (`forests`). With `leaf_wise` the second one grows best-first and places missing
    values itself (`boosting.boost`), as a second algorithm; without, it is the first one with another seed. A
    best-first round is one job per level, so it takes some times as long as the first member and is not the default.
    """

    members: tuple[str, ...] = ("boosted_a", "boosted_b", "logistic")
    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    subsample: float = 0.8
    seed: int = 42
    max_iter: int = 1000
    leaf_wise: bool = False
    key: str = "game_pk"


@dataclass
class Ensemble:
    features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    models: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @property
    def weights(self) -> dict[str, float]:
        return member_weights(list(self.models))


def member_weights(names: Sequence[str], configured: dict[str, float] | None = None) -> dict:
    """Configured weights renormalised over the members present; equal parts if none is known."""
    if not names:
        return {}
    table = K.MEMBER_WEIGHTS if configured is None else configured
    raw = {n: table.get(n, 0.0) for n in names}
    total = sum(raw.values())
    if total <= 0:
        return {n: 1.0 / len(raw) for n in raw}
    return {n: w / total for n, w in raw.items()}


# --- inputs ----------------------------------------------------------------------------------------

def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m))
                           for c, m in medians.items()})


def input_stats(train: DataFrame, features: Sequence[str]) -> Ensemble:
    """Medians, and means and deviations after filling, from training rows only.

    What returns to the driver is one number per feature and statistic.
    """
    med = {r["feature"]: r["median"] for r in drift.medians(train, features).collect()}
    filled = impute(train.select(*features), med)
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return Ensemble(list(features), med, {c: row[f"m_{c}"] or 0.0 for c in features},
                    {c: row[f"s_{c}"] or 1.0 for c in features})


def vectors(df: DataFrame, ens: Ensemble) -> DataFrame:
    """Add `_linear` (filled, standardised) and `_tree` (filled, with missing flags)."""
    fs = ens.features
    z = {f"_z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(ens.medians[c]))
                     - F.lit(ens.means[c])) / F.lit(ens.scales[c]) for c in fs}
    t = {f"_t_{c}": F.coalesce(F.col(c).cast("double"), F.lit(ens.medians[c])) for c in fs}
    m = {f"_m_{c}": F.col(c).isNull().cast("double") for c in fs}
    out = df.withColumns({**z, **t, **m})
    out = VectorAssembler(inputCols=list(z), outputCol="_linear").transform(out)
    out = VectorAssembler(inputCols=[*t, *m], outputCol="_tree").transform(out)
    return out.drop(*z, *t, *m)


def side_by_side(spark: SparkSession, calls: Sequence[Callable], at_once: int | None = None) -> list:
    """What the calls return, in their order. A boosted member is a long sequence of small jobs: independent ones are
    submitted together, so that one's jobs run on the cores that another's leave idle. All have ended on return."""
    calls = list(calls)
    with ThreadPoolExecutor(max(1, min(at_once or len(calls), len(calls)))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
    return [r.result() for r in running]


def few_tasks(data: DataFrame, n: int) -> DataFrame:
    """The n rows in tasks of some TASK_ROWS, if that is fewer than the files have but no fewer than cores: every
    round runs a job a level over all tasks, and starting a task outweighs its work where it has few rows."""
    return data.coalesce(max(-(-n // TASK_ROWS), data.sparkSession.sparkContext.defaultParallelism))


# --- fit and predict -------------------------------------------------------------------------------

def _boosted(name: str, s: Settings, **rules) -> forests.Boosted:
    return forests.Boosted(forests.Rules(**{
        "rounds": s.rounds, "depth": s.depth, "rate": s.rate, "subsample": s.subsample,
        "seed": s.seed + (name == "boosted_b"), "share": 0.8, **rules}))


def fit(train: DataFrame, features: Sequence[str], settings: Settings | None = None,
        label: str = "home_win") -> Ensemble:
    """Train the members on decided rows, side by side."""
    s = settings or Settings()
    train = train.where(F.col(label).isNotNull())
    ens = input_stats(train, features)
    n = train.count()
    data = few_tasks(vectors(train, ens).select("_linear", F.col(label).cast("double").alias("_label")), n).persist()
    grown = [m for m in s.members if m != "logistic" and not (m == "boosted_b" and s.leaf_wise)]
    rows = forests.binned(train, features, ens.medians, label, n) if grown else None

    def member(name: str):
        if name == "logistic":
            # mean loss + (1/n)/2 |w|^2 is the usual unit-strength L2 penalty
            return LogisticRegression(featuresCol="_linear", labelCol="_label", maxIter=s.max_iter,
                                      regParam=1.0 / n, standardization=False).fit(data)
        if name == "boosted_b" and s.leaf_wise:
            return boosting.boost(train, features, label, replace(
                boosting.LEAF_WISE, rounds=s.rounds, depth=s.depth, rate=s.rate, subsample=s.subsample,
                seed=s.seed + 1), s.key)
        return _boosted(name, s).fit(rows)

    try:
        ens.models = dict(zip(s.members, side_by_side(
            train.sparkSession, [lambda name=name: member(name) for name in s.members])))
    finally:
        data.unpersist()
        if rows:
            rows.unpersist()
    return ens


def member_probabilities(ens: Ensemble, df: DataFrame) -> DataFrame:
    """Add `p_<member>` per member and the blend; 0.5 without members."""
    out = df if all(isinstance(m, boosting.Forest) for m in ens.models.values()) else vectors(df, ens)
    for name, model in ens.models.items():
        if isinstance(model, boosting.Forest):
            out = out.withColumn(f"p_{name}", forests.predicted(df, model))
            continue
        cols = {c: f"_{name}_{c}" for c in ("prediction", "probability", "rawPrediction")}
        out = model.transform(out).withColumnsRenamed(cols)
        out = (out.withColumn(f"p_{name}", vector_to_array(cols["probability"])[1])
               .drop(*cols.values()))
    out = out.drop("_linear", "_tree")
    return blended(out, ens.weights)


def blended(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add the weighted sum of the member columns `p_<member>`; 0.5 without members."""
    if not weights:
        return df.withColumn("home_win_prob_model", F.lit(0.5))
    return df.withColumn("home_win_prob_model", reduce(
        lambda a, b: a + b, [F.lit(w) * F.col(f"p_{n}") for n, w in weights.items()]))


def predict_games(ens: Ensemble, games: DataFrame) -> DataFrame:
    """Rounded probabilities, the pick, and edges against the market."""
    return with_picks(member_probabilities(ens, games).drop(*[f"p_{n}" for n in ens.models]))


def with_picks(out: DataFrame) -> DataFrame:
    """What `predict_games` adds to rows that have `home_win_prob_model`."""
    out = out.withColumn("home_win_prob_model", S.half_even("home_win_prob_model", 4))
    out = out.withColumns({
        "away_win_prob_model": S.half_even(1 - F.col("home_win_prob_model"), 4),
        "model_pick": S.pick("home_win_prob_model")})
    if "moneyline_home" not in out.columns:
        return out.withColumns({"edge_home": F.lit(0.0), "edge_away": F.lit(0.0)})
    return metrics.edges_against_market(out)


# --- walk-forward ----------------------------------------------------------------------------------

def walk_forward(games: DataFrame, features: Sequence[str], settings: Settings | None = None,
                 min_train: int = 10, min_val: int = 5, **fold_options) -> DataFrame | None:
    """Out-of-fold rows with `p_<member>`, the blend and `fold_idx`; None without usable folds.

    The driver knows fold boundaries only; training sets are date filters of the games, which are written once.
    A fold with boosted members whose rows fit a task is trained in a task of its own, all such folds in one job;
    others are trained by jobs of their own, FOLDS_AT_ONCE side by side, and their rows written and read together.
    """
    s = settings or Settings()
    spark = games.sparkSession
    stage = Stage(spark)
    columns = games.columns
    games = stage.put("games", games.withColumn("_row", F.monotonically_increasing_id()))

    def score(f) -> DataFrame:
        ens = fit(folds.training_rows(games, f["val_start"]), features, settings)
        val = folds.validation_rows(games, f["val_start"], f["val_end"])
        return stage.put(f"fold_{f['fold_idx']}", member_probabilities(ens, val).withColumn(
            "fold_idx", F.lit(f["fold_idx"])))

    usable = [f for f in folds.fold_table(games, **fold_options).orderBy("fold_idx").collect()
              if f["n_train"] >= min_train and f["n_val"] >= min_val]
    boosted = set(s.members) - {"logistic"}
    in_task = [f for f in usable if boosted and not s.leaf_wise and f["n_train"] <= forests.ROWS_IN_TASK]
    in_jobs = [f for f in usable if f not in in_task]
    out = None
    if in_jobs:
        scored = side_by_side(spark, [lambda f=f: score(f) for f in in_jobs], FOLDS_AT_ONCE)
        out = spark.read.schema(scored[0].schema).parquet(*[
            f"{stage.folder}/fold_{f['fold_idx']}" for f in in_jobs]).drop("_row")
    if in_task:
        found = blended(games.join(stage.put("scored", folds_in_tasks(stage, games, features, s, in_task)), "_row"),
                        member_weights(s.members)).select(
            *columns, *[f"p_{m}" for m in s.members], "home_win_prob_model", "fold_idx")
        out = out.unionByName(found) if out else found
    return out


def folds_in_tasks(stage: Stage, games: DataFrame, features: Sequence[str], s: Settings, found: Sequence) -> DataFrame:
    """(_row, fold_idx, p_<member>...) of the validation rows of the folds, one task a fold, the largest first.

    The tasks read the days up to their fold from a table of days, labels and features, written once. It is in the
    order of its values, so that equal games give equal draws however they were dealt.
    """
    spark = games.sparkSession
    ship_package(spark)
    names = list(features)
    stage.put("matrix", games.where(F.col("home_win").isNotNull() & F.col("game_date").isNotNull()).select(
        "_row", F.unix_date(F.to_date("game_date")).alias("_day"), F.col("home_win").cast("double").alias("_y"),
        *[F.col(f).cast("double").alias(f) for f in names]).repartitionByRange("_day", *names, "_y")
        .sortWithinPartitions("_day", *names, "_y"))
    path = f"{stage.folder}/matrix"

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            for fold, start, end in zip(*[c.to_pylist() for c in b.columns]):
                held = forests.read_shared(path, ["_row", "_day", "_y", *names], [("_day", "<=", end)])
                day, y = held.pop("_day"), held.pop("_y")
                row, val = held.pop("_row"), day >= start
                members = fold_members(held, y, day < start, val, s)
                yield pa.RecordBatch.from_pydict({
                    "_row": row[val], "fold_idx": np.full(val.sum(), fold, np.int32),
                    **{f"p_{m}": p for m, p in members.items()}})

    epoch = date(1970, 1, 1).toordinal()
    sized = sorted(found, key=lambda f: -f["n_train"])
    table = spark.createDataFrame(spark.sparkContext.parallelize(
        [(f["fold_idx"], f["val_start"].toordinal() - epoch, f["val_end"].toordinal() - epoch) for f in sized],
        len(sized)), "fold_idx int, val_start int, val_end int")
    return table.mapInArrow(scored, "_row long, fold_idx int, " + ", ".join(f"p_{m} double" for m in s.members))


def fold_members(values: dict[str, np.ndarray], y: np.ndarray, train: np.ndarray, val: np.ndarray,
                 s: Settings) -> dict[str, np.ndarray]:
    """Probabilities of the validation rows by members fitted to the training rows, all in arrays."""
    some = {f: x[train] for f, x in values.items()}
    have = {f: x[~np.isnan(x)] for f, x in some.items()}
    medians = {f: float(np.median(x)) if len(x) else 0.0 for f, x in have.items()}
    inputs = forests.Inputs(tuple(values), tuple(tuple(forests.cuts_of(x)) for x in some.values()),
                            tuple(medians.values()))
    asked, out = {f: x[val] for f, x in values.items()}, {}
    bins = inputs.bins(list(some.values()))
    parts = [slice(i, i + forests.BLOCK) for i in range(0, bins.shape[1], forests.BLOCK)]
    for name in s.members:
        if name == "logistic":
            filled = {f: np.where(np.isnan(x), medians[f], x) for f, x in some.items()}
            means = {f: x.mean() for f, x in filled.items()}
            scales = {f: x.std() or 1.0 for f, x in filled.items()}
            scaled = lambda f, x: (np.where(np.isnan(x), medians[f], x) - means[f]) / scales[f]
            w = unit_penalty_weights(np.stack([scaled(f, x) for f, x in some.items()], 1), y[train])
            z = np.stack([scaled(f, x) for f, x in asked.items()], 1) @ w[:-1] + w[-1]
            with np.errstate(over="ignore"):
                out[name] = 1 / (1 + np.exp(-z))
            continue
        rules = _boosted(name, s).rules
        blocks = [forests.Block((0, i), np.ascontiguousarray(bins[:, at]), y[train][at], rules)
                  for i, at in enumerate(parts)]
        forest = forests.as_forest(forests.grown_here(blocks, inputs, rules), inputs, rules)
        out[name] = forests.predictions(forest, asked, int(val.sum()))
    return out


def unit_penalty_weights(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the free intercept that minimise mean log loss + (1/n)/2 |w|^2, by damped Newton steps."""
    n, width = z.shape
    w = np.zeros(width + 1)
    if (y == y[0]).all():
        w[-1] = np.inf if y[0] > 0 else -np.inf      # as MLlib does with one label only
        return w
    x = np.column_stack([z, np.ones(n)])
    ridge = np.append(np.full(width, 1 / n), 0.0)
    cost = lambda w: np.logaddexp(0, (1 - 2 * y) * (x @ w)).mean() + (ridge * w * w).sum() / 2
    now = cost(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) / n + ridge * w
        if np.abs(slope).max() < 1e-10:
            break
        step = np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x / n + np.diag(ridge), slope, rcond=None)[0]
        part = 1.0
        while part > 1e-6 and cost(w - part * step) > now:
            part /= 2
        if part <= 1e-6:
            break
        w = w - part * step
        now = cost(w)
    return w


def roster(oof: DataFrame, deployed: Sequence[str]) -> DataFrame:
    """Every configured or deployed member with its weight and pooled out-of-fold metrics."""
    weights = member_weights(list(deployed)) if deployed else {}
    names = list(dict.fromkeys([*K.MEMBER_WEIGHTS, *deployed]))
    table = oof.sparkSession.createDataFrame(
        [(n, round(weights.get(n, 0.0), 4)) for n in names], "name string, weight double")
    scored = [n for n in names if f"p_{n}" in oof.columns]
    if not scored:
        return table.withColumns({**{c: F.lit(None).cast("double")
                                     for c in ("auc", "brier", "logloss")},
                                  "n_eval": F.lit(0).cast("bigint")})
    long = (oof.select("home_win", *[F.col(f"p_{n}").alias(n) for n in scored])
            .unpivot(["home_win"], scored, "name", "p"))
    m = metrics.binary_metrics(long, "home_win", "p", ["name"]).drop("ece")
    return (table.join(m, "name", "left")
            .select("name", "weight", "auc", "brier", "logloss",
                    F.coalesce("n", F.lit(0)).alias("n_eval")))


def evaluate(games: DataFrame, features: Sequence[str], settings: Settings | None = None,
             refit_on_last_fold: bool = False, **fold_options):
    """(ensemble, pooled metrics row, out-of-fold rows, roster).

    The deployed ensemble is refit on all decided games, or on the training rows of the last fold.
    Without folds it is scored on the newest decided games it was trained on.
    """
    oof = walk_forward(games, features, settings, **fold_options)
    decided = games.where(F.col("home_win").isNotNull())
    train = decided
    if refit_on_last_fold and oof is not None:
        last = (folds.fold_table(games, **fold_options)
                .orderBy(F.desc("fold_idx")).limit(1).first())
        train = folds.training_rows(games, last["val_start"])
    ens = fit(train, features, settings)
    if oof is None:
        newest = decided.orderBy(F.desc("game_date"), F.desc("game_pk")).limit(50)
        oof = member_probabilities(ens, newest).withColumn("fold_idx", F.lit(0))
    pooled = metrics.binary_metrics(oof)
    return ens, pooled, oof, roster(oof, list(ens.models))


def should_retrain(last_trained: datetime | None, now: datetime,
                   cadence_days: int = K.RETRAIN_CADENCE) -> bool:
    return last_trained is None or now - last_trained >= timedelta(days=cadence_days)


# --- other heads -----------------------------------------------------------------------------------

def _regressor(name: str, s: Settings) -> forests.Boosted:
    return _boosted(name, s, share=1.0, loss="squared")


def totals_head(train: DataFrame, val: DataFrame, features: Sequence[str],
                settings: Settings | None = None, label: str = "total_runs"):
    """(predictions, error row): mean of two boosted regressors of the run total."""
    s = settings or Settings(rounds=200, depth=4)
    train = train.where(F.col(label).isNotNull())
    ens = input_stats(train, features)
    rows = forests.binned(train, features, ens.medians, label, train.count())
    names = ("boosted_a", "boosted_b")
    try:
        both = side_by_side(train.sparkSession, [lambda name=name: _regressor(name, s).fit(rows) for name in names])
    finally:
        rows.unpersist()
    out = val.withColumn("total_runs_model", reduce(
        lambda a, b: a + b, [forests.predicted(val, forest) for forest in both]) / 2)
    return out, metrics.regression_errors(out, label, "total_runs_model")


def cover_label(margin: int = 2, as_home_win: bool = False):
    """Home side wins by at least `margin`; with `as_home_win` any home win counts."""
    if as_home_win:
        return F.when(F.col("home_win").isNotNull(), (F.col("home_win") == 1).cast("double"))
    return ((F.col("home_score") - F.col("away_score")) >= margin).cast("double")


def run_line_head(train: DataFrame, val: DataFrame, features: Sequence[str],
                  settings: Settings | None = None, as_home_win: bool = False):
    """(predictions, metrics row) of the run-line cover probability."""
    s = settings or Settings(members=("boosted_a", "boosted_b"))
    label = cover_label(as_home_win=as_home_win)
    ens = fit(train.withColumn("_cover", label), features, s, label="_cover")
    out = member_probabilities(ens, val.withColumn("_cover", label))
    return out, metrics.binary_metrics(out, "_cover", "home_win_prob_model")


# --- attribution -----------------------------------------------------------------------------------

def attributions(ens: Ensemble, games: DataFrame, key: str = "game_id",
                 top: int | None = None, member: str = "logistic") -> DataFrame:
    """(game, feature, attribution, signed_effect, rank): exact log-odds shares of the linear
    member, relative to the training mean, largest first; or the path-wise shares of a best-first member.

    Keys are counted first. Where a key has one row, its shares are ranked within the row and nothing is
    shuffled; only rows of repeated keys, ranked together, are laid out and sorted by key.
    """
    from pyspark.sql import Window

    if isinstance(ens.models[member], boosting.Forest):
        return boosting.tree_attributions(ens.models[member], games, ens.features, key, top)

    coef = ens.models[member].coefficients.toArray()
    share = {c: F.bround(F.lit(float(w)) * (
        (F.coalesce(F.col(c).cast("double"), F.lit(ens.medians[c])) - F.lit(ens.means[c]))
        / F.lit(ens.scales[c])), 6) for c, w in zip(ens.features, coef)}
    repeated = (games.groupBy(F.col(key).alias("_repeated")).count().where(F.col("count") > 1)
                .select("_repeated"))
    once, more = games, None
    if not repeated.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_repeated"))
        once, more = games.join(repeated, same, "left_anti"), games.join(repeated, same, "left_semi")

    effect = F.when(F.col("attribution") > 0, "positive").otherwise("negative").alias("signed_effect")
    by_name = {c: -i for i, c in enumerate(sorted(share, key=str.encode))}
    entries = F.sort_array(F.array(*[
        F.struct(F.abs(c).alias("size"), F.lit(by_name[c]).alias("name"), F.lit(c).alias("feature"),
                 F.col(c).alias("attribution")) for c in share]), asc=False)
    # the shares are columns of their own first: inside the generator each would be rounded twice
    ranked = (once.select(key, *[v.alias(c) for c, v in share.items()])
              .select(key, (F.slice(entries, 1, top) if top else entries).alias("_entries"))
              .select(key, F.posexplode("_entries").alias("_at", "_e"))
              .select(key, "_e.feature", "_e.attribution", "_at")
              .select(key, "feature", "attribution", effect, (F.col("_at") + 1).alias("rank")))
    if more is None:
        return ranked
    long = (more.select(key, *[v.alias(c) for c, v in share.items()])
            .unpivot([key], ens.features, "feature", "attribution"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("attribution").desc(), "feature"))
    together = long.select(key, "feature", "attribution", effect, rank.alias("rank"))
    return ranked.unionByName(together.where(F.col("rank") <= top) if top else together)


# --- persistence -----------------------------------------------------------------------------------

def save(ens: Ensemble, pooled: dict, path: str, spark: SparkSession, version: str,
         trained_at: datetime, data_cutoff: str) -> None:
    forests = {}
    for name, model in ens.models.items():
        if isinstance(model, boosting.Forest):
            forests[name] = asdict(model)
            continue
        model.write().overwrite().save(f"{path}/{name}")
    row = (version, trained_at.isoformat(), data_cutoff, json.dumps(pooled),
           json.dumps({"features": ens.features, "medians": ens.medians, "means": ens.means,
                       "scales": ens.scales, "members": list(ens.models), "forests": forests}))
    spark.createDataFrame(
        [row], "version string, trained_at string, data_cutoff string, metrics string, "
               "inputs string").write.mode("overwrite").parquet(f"{path}/metadata")


def load(path: str, spark: SparkSession) -> Ensemble | None:
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/metadata").first()
    except AnalysisException:
        return None
    i = json.loads(meta["inputs"])
    return Ensemble(
        i["features"], i["medians"], i["means"], i["scales"],
        {n: _forest(i["forests"][n]) if n in i.get("forests", {}) else _LOADERS[n].load(f"{path}/{n}")
         for n in i["members"]},
        {"version": meta["version"], "trained_at": meta["trained_at"],
         "data_cutoff": meta["data_cutoff"], "metrics": json.loads(meta["metrics"])})


def _forest(saved: dict) -> boosting.Forest:
    return boosting.Forest(saved["base"], [{int(k): boosting.Node(**n) for k, n in tree.items()}
                                           for tree in saved["trees"]], saved["loss"])
