"""Boosted trees on pyspark.ml: training, cross-validation, refit, importances, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from seqloom.operators import metrics as M
from seqloom.operators.dependence import matrix
from seqloom.operators.quantiles import bin_of
from seqloom.session import cut


# The trainer's default settings.
@dataclass(frozen=True)
class BoostSettings:
    """Depth 5 stands for 31 leaves; depth 1 gives two-leaf trees and an additive model."""

    iterations: int = 1000
    step: float = 0.1
    depth: int = 5
    bins: int = 255
    min_rows: int = 20
    patience: int = 20
    positive_weight: float = 1.0
    seed: int = 42


def stumps(settings: BoostSettings) -> BoostSettings:
    return replace(settings, depth=1)


def _training_rows(df: DataFrame, vector: str, label: str, settings: BoostSettings) -> DataFrame:
    weighted = M.class_weight(df, label, settings.positive_weight)
    return weighted.select(
        array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"), "weight"
    )


def train_boosted(df: DataFrame, vector: str, label: str, settings: BoostSettings) -> GBTClassificationModel:
    """Gradient-boosted trees for a binary label."""
    trainer = GBTClassifier(
        maxIter=settings.iterations,
        stepSize=settings.step,
        maxDepth=settings.depth,
        maxBins=settings.bins,
        minInstancesPerNode=settings.min_rows,
        weightCol="weight",
        seed=settings.seed,
    )
    return trainer.fit(_training_rows(df, vector, label, settings))


def train_stumps(df: DataFrame, vector: str, label: str, settings: BoostSettings) -> GBTClassificationModel:
    return train_boosted(df, vector, label, stumps(settings))


def save_model(model, path: str, best_iteration: int, **facts) -> None:
    """The model beside a one-row table of what goes with it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    row = {"best_iteration": best_iteration, **facts}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str):
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    return GBTClassificationModel.load(f"{path}/model"), facts


def tree_nodes(spark: SparkSession, model: GBTClassificationModel, folder: str) -> DataFrame:
    """(tree, weight, node, prediction, gain, n, left, right, feature, cut) of a saved copy of the model."""
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("tree", "meta", "weight").select("tree", "weight")
    return nodes.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        "prediction",
        "gain",
        F.col("rawCount").alias("n"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut"),
    ).join(F.broadcast(weights), "tree")


def split_gain_importance(nodes: DataFrame, names: Sequence[str], upto: int | None = None) -> DataFrame:
    """(feature, split, gain) of every feature, zero where it is never used."""
    inner = nodes.filter("left >= 0")
    if upto is not None:
        inner = inner.filter(F.col("tree") < upto)
    used = inner.groupBy("feature").agg(F.count("*").alias("split"), F.sum("gain").alias("gain"))
    named = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    return named.join(used, "feature", "left").select(
        F.col("name").alias("feature"),
        F.coalesce("split", F.lit(0)).cast("double").alias("split"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"),
    )


def stump_table(nodes: DataFrame) -> DataFrame:
    """(feature, cut, low, high) of a two-leaf model, with the trees' weights applied."""
    root = nodes.filter("node = 0 and left >= 0").select("tree", "weight", "feature", "cut", "left", "right")
    leaf = nodes.select("tree", F.col("node").alias("_leaf"), F.col("prediction").alias("_p"))
    low = leaf.select("tree", F.col("_leaf").alias("left"), F.col("_p").alias("_low"))
    high = leaf.select("tree", F.col("_leaf").alias("right"), F.col("_p").alias("_high"))
    return root.join(low, ["tree", "left"]).join(high, ["tree", "right"]).select(
        "feature", "cut", (F.col("_low") * F.col("weight")).alias("low"), (F.col("_high") * F.col("weight")).alias("high")
    )


@dataclass
class Forest:
    """A model's trees as arrays, small enough to travel with a task."""

    trees: list[dict]

    @classmethod
    def of(cls, nodes: DataFrame) -> "Forest":
        rows = nodes.toPandas().sort_values(["tree", "node"])
        out = []
        for _, t in rows.groupby("tree"):
            t = t.set_index("node")
            out.append({c: t[c].to_numpy() for c in ("prediction", "left", "right", "feature")}
                       | {"cut": t["cut"].fillna(0.0).to_numpy(), "weight": float(t["weight"].iloc[0])})
        return cls(out)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Weighted tree outputs summed up to and including each tree: rows x trees."""
        out = np.empty((len(x), len(self.trees)))
        for i, t in enumerate(self.trees):
            at = self.leaves(t, x)
            out[:, i] = t["prediction"][at] * t["weight"]
        return np.cumsum(out, axis=1)

    def contributions(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """What each feature adds to a row's margin: rows x features.

        At every split on a row's way the step from the node's value to the child's belongs to the split's feature.  A leaf's steps
        are summed up once, so a row takes one line per tree.  For two-leaf trees this is the exact attribution
        against the training rows.
        """
        out = np.zeros(x.shape)
        for t in self.trees if upto is None else self.trees[: max(1, upto)]:
            lines = np.zeros((len(t["left"]), x.shape[1]))
            for node in np.flatnonzero(t["left"] >= 0):  # parents come before their children
                for child in (t["left"][node], t["right"][node]):
                    lines[child] = lines[node]
                    lines[child, t["feature"][node]] += (t["prediction"][child] - t["prediction"][node]) * t["weight"]
            out += lines[self.leaves(t, x)]
        return out

    @staticmethod
    def leaves(t: dict, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in one tree."""
        at = np.zeros(len(x), dtype="int64")
        while (inner := t["left"][at] >= 0).any():
            go_left = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["cut"][at]
            at = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margins(x)[:, -1]))

    def total(self, x: np.ndarray) -> np.ndarray:
        """The margin after the last tree.

        Two-leaf trees of a feature are steps: a row's place among their cuts tells what all of them add.
        """
        if not self.trees or any((t["left"] >= 0).sum() > 1 for t in self.trees):
            return self.margins(x)[:, -1]
        out, steps = np.zeros(len(x)), {}
        for t in self.trees:
            if t["left"][0] < 0:
                out += t["prediction"][0] * t["weight"]
            else:
                sides = (t["prediction"][t[side][0]] * t["weight"] for side in ("left", "right"))
                steps.setdefault(int(t["feature"][0]), []).append((t["cut"][0], *sides))
        for feature, rows in steps.items():
            cut, low, high = np.array(sorted(rows)).T
            # a value has the high side of the cuts below it, the low side of the others
            added = np.append(0.0, np.cumsum(high)) + np.append(np.cumsum(low[::-1])[::-1], 0.0)
            out += added[np.searchsorted(cut, x[:, feature])]
        return out

    def prefix_scores(self, vector: Column | str) -> Column:
        """Probability after each tree, as an array."""

        @pandas_udf("array<double>")
        def scores(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="object")
            p = 1 / (1 + np.exp(-2 * self.margins(np.stack(v.to_list()))))
            return pd.Series(list(p))

        return scores(vector)

    def score(self, vector: Column | str, upto: int | None = None) -> Column:
        """Probability after ``upto`` trees (all by default)."""
        used = Forest(self.trees if upto is None else self.trees[: max(1, upto)])

        @F.arrow_udf("double")
        def scores(v: pa.Array) -> pa.Array:
            if v.null_count:
                raise ValueError("a row without features")
            if not len(v):
                return pa.array([], pa.float64())
            return pa.array(1 / (1 + np.exp(-2 * used.total(matrix(v)))))

        return scores(vector)


def best_iteration(scores: DataFrame, patience: int = 20) -> DataFrame:
    """One row: the iteration whose mean fold metric first peaks and holds for ``patience`` rounds.

    ``scores`` is (fold, iteration, metric).  There is one mean per iteration, so the
    curve that is ordered is as long as the training is, whatever the rows.
    """
    curve = scores.groupBy("iteration").agg(F.round(F.avg("metric"), 9).alias("mean"))
    order = W.partitionBy(F.lit(0)).orderBy("iteration")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    records = curve.withColumn("_best", F.max("mean").over(earlier)).filter("_best is null or mean > _best")
    gap = F.lead("iteration").over(order) - F.col("iteration")
    held = records.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > patience))
    first = F.min(F.struct("iteration", "mean")).alias("_b")
    return held.agg(first).select("_b.iteration", "_b.mean")


def mean_attributions(rows: DataFrame, by: str, vector: str, forest: Forest, upto: int | None = None) -> DataFrame:
    """(by, feature, total, n): the sum of the absolute contributions of each feature, and the rows they are of.

    A task adds up what its rows have; one number per group and feature leaves it.
    """
    kind = rows.schema[by].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.abs(forest.contributions(matrix(batch.column("_x")), upto))
            group, which = batch.column(by).type, batch.column(by).dictionary_encode()
            codes = which.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(which.dictionary.to_pylist()):
                own = size[codes == code]
                before, n = total.get(name, (0.0, 0))
                total[name] = before + own.sum(axis=0), n + len(own)
        for name, (sums, n) in total.items():
            yield pa.RecordBatch.from_pydict(
                {by: pa.array([name] * len(sums), group), "feature": np.arange(len(sums), dtype=np.int32), "total": sums, "n": np.full(len(sums), n)}
            )

    chosen = rows.select(by, F.col(vector).cast("array<double>").alias("_x"))
    parts = chosen.mapInArrow(task, f"{by} {kind}, feature int, total double, n long")
    return parts.groupBy(by, "feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def stopping_curve(rows: DataFrame, stop_on: str | Callable, threshold: float = 0.5) -> DataFrame:
    """(fold, iteration, metric) of held-out rows (fold, iteration, _y, p)."""
    by = ["fold", "iteration"]
    if callable(stop_on):
        return stop_on(rows, by, "_y", "p")
    if stop_on == "AUROC":
        return M.auroc(rows, by, "_y", "p").withColumnRenamed("AUROC", "metric")
    counts = M.confusion(rows.withColumn("_predicted", M.threshold_label("p", threshold)), by, "_y", "_predicted")
    return counts.select(*by, M.score_by(stop_on)().alias("metric"))


@dataclass
class Validation:
    """Everything a cross-validation gives."""

    scores: DataFrame  # dataset, fold, metrics
    train_predictions: DataFrame  # keys, fold, p, predicted: out of fold, null where no fold covers a row
    test_predictions: DataFrame | None  # keys, p, predicted: mean over the fold models
    importances: DataFrame  # fold, feature, split, gain
    best_iteration: int
    forests: list[Forest] = field(default_factory=list)
    refit_model: GBTClassificationModel | None = None
    refit_forest: Forest | None = None
    attributions: DataFrame | None = None  # dataset, fold, feature, attribution: mean absolute contribution
    custom: DataFrame | None = None  # what the caller's own metric gave for each dataset and fold


#: Models that one validation fits; folds of single rows are assigned and scored, not fitted.
MOST_FITS = 1000


def refuse_many(fits: int) -> None:
    if fits > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} folds, each of which needs a fit of its own")


def cross_validate(
    train: DataFrame,
    test: DataFrame | None,
    keys: Sequence[str],
    vector: str,
    label: str,
    names: Sequence[str],
    settings: BoostSettings,
    scratch: str,
    fold: str = "fold",
    repeat: str | None = None,
    threshold: float = 0.5,
    refit: bool = True,
    refit_multiplier: float = 1.0,
    parallelism: int = 4,
    metric: Callable | None = None,
    stop_on: str | Callable = "AUROC",
    written: bool = False,
) -> Validation:
    """Fit one model per fold, stop all at the shared best iteration, score, average, refit.

    ``stop_on`` is the metric whose mean over the folds chooses the iteration: a name of `metrics`, or a function of
    (rows, by, label, score) that gives one row with ``metric`` for each group.  High is good.

    The table is written once (or is ``written`` already) and read by every fit; fits run side by side, so that
    executors stay busy while one of them is between jobs.  With ``repeat`` the table has each
    row once per repeat; a repeat's folds are numbered on from those before it, and a row's
    out-of-fold score is the mean over the repeats.
    """
    spark = train.sparkSession
    once = F.lit(0) if repeat is None else F.col(repeat)
    data = train.select(
        *keys, F.col(vector).alias("_x"), F.col(label).alias("_y"), F.col(fold).alias("_in"), once.alias("_repeat")
    )
    data = data if written else cut(data)
    # one model per pair of these, so there are as many as there are fits
    found = data.select("_repeat", "_in").distinct().filter("_in is not null").limit(MOST_FITS + 1).collect()
    refuse_many(len(found))
    pairs = sorted(tuple(r) for r in found)
    folds = list(enumerate(pairs))

    def fit(job):
        f, (r, held) = job
        rows = data.filter((F.col("_repeat") == r) & (F.col("_in") != held))
        nodes = tree_nodes(spark, train_boosted(rows, "_x", "_y", settings), f"{scratch}/fold{f}")
        return f, Forest.of(nodes), nodes

    with ThreadPool(parallelism) as pool:
        fitted = pool.map(fit, folds)

    # only held-out rows are scored after every tree; their curve sets the shared iteration count
    waiting = None
    for (f, forest, _), (_, (r, held)) in zip(fitted, folds):
        own = data.filter((F.col("_repeat") == r) & (F.col("_in") == held))
        part = own.select("_y", F.lit(f).alias("fold"), F.posexplode(forest.prefix_scores("_x")).alias("_i", "p"))
        waiting = part if waiting is None else waiting.unionByName(part)
    curve = stopping_curve(waiting.withColumn("iteration", F.col("_i") + 1), stop_on, threshold)
    chosen = best_iteration(curve, settings.patience).first()
    best = int(chosen["iteration"]) if chosen and chosen["iteration"] else settings.iterations

    scored = None
    for (f, forest, _), (_, (r, held)) in zip(fitted, folds):
        own = data.filter(F.col("_repeat") == r)
        part = own.select(
            *keys, "_y", (F.col("_in") == held).alias("_held"), F.lit(f).alias("fold"), forest.score("_x", best).alias("p")
        )
        scored = part if scored is None else scored.unionByName(part)
    scored = cut(scored)
    p = "p"
    rows = scored.select(
        F.when(F.col("_held"), "Valid").otherwise("Train").alias("dataset"), "fold", "_y", p
    )
    waited = scored.filter("_held").select(*keys, "fold", p)
    out_of_fold = (
        data.select(*keys).distinct()
        .join(waited.groupBy(*keys).agg(F.min("fold").alias("fold"), F.avg("p").alias("p")), list(keys), "left")
        .withColumn("predicted", M.threshold_label("p", threshold))
    )

    test_predictions = None
    if test is not None:
        asked = cut(test.select(*keys, F.col(vector).alias("_x"), F.col(label).alias("_y")))
        each = None
        for f, forest, _ in fitted:
            part = asked.select(*keys, "_y", forest.score("_x", best).alias("p"))
            each = part if each is None else each.unionByName(part)
        ensemble = M.ensemble_average(each, [*keys, "_y"], "p")
        test_predictions = cut(ensemble.withColumn("predicted", M.threshold_label("p", threshold)))
        rows = rows.unionByName(
            test_predictions.select(F.lit("Test_ensemble").alias("dataset"), F.lit(0).alias("fold"), "_y", "p")
        )

    result = Validation(rows, out_of_fold, test_predictions, None, best, [f for _, f, _ in fitted])
    if refit:
        trees = max(1, int(best * refit_multiplier))
        whole = data if repeat is None else data.filter(F.col("_repeat") == pairs[0][0])
        result.refit_model = train_boosted(whole, "_x", "_y", replace(settings, iterations=trees))
        result.refit_forest = Forest.of(tree_nodes(spark, result.refit_model, f"{scratch}/refit"))
        if test is not None:
            again = asked.select(
                F.lit("Test_refit").alias("dataset"), F.lit(0).alias("fold"), "_y", result.refit_forest.score("_x").alias("p")
            )
            rows = rows.unionByName(again)

    rows = cut(rows)
    result.scores = M.metric_report(rows, ["dataset", "fold"], "_y", "p", threshold)
    importances = None
    for f, _, nodes in fitted:
        part = split_gain_importance(nodes, names, best).withColumn("fold", F.lit(f))
        importances = part if importances is None else importances.unionByName(part)
    result.importances = importances
    each = None
    for (f, forest, _), (_, (r, held)) in zip(fitted, folds):
        own = data.filter(F.col("_repeat") == r).select(F.when(F.col("_in") == held, "Valid").otherwise("Train").alias("dataset"), "_x")
        own = own if test is None else own.unionByName(asked.select(F.lit("Test").alias("dataset"), "_x"))
        part = mean_attributions(own, "dataset", "_x", forest, best).withColumn("fold", F.lit(f))
        each = part if each is None else each.unionByName(part)
    numbered = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    result.attributions = each.join(F.broadcast(numbered), "feature").select(
        "dataset", "fold", F.col("name").alias("feature"), (F.col("total") / F.col("n")).alias("attribution")
    )
    if metric is not None:
        for own, f in sorted(tuple(r) for r in rows.select("dataset", "fold").distinct().collect()):  # as many as fits
            one = rows.filter((F.col("dataset") == own) & (F.col("fold") == f)).select("_y", "p")
            part = metric(one, "_y", "p").withColumn("dataset", F.lit(own)).withColumn("fold", F.lit(f))
            result.custom = part if result.custom is None else result.custom.unionByName(part)
    return result


def fold_importances(result: Validation) -> DataFrame:
    """(fold, feature, split, gain, Train, Valid, Test): every importance a feature has in a fold's model."""
    wide = result.attributions.groupBy("fold", "feature").pivot("dataset", ["Train", "Valid", "Test"]).agg(F.first("attribution"))
    return result.importances.join(wide, ["fold", "feature"])


def slice_vector(vector: str, places: Sequence[int]) -> Column:
    return F.array(*[F.get(F.col(vector), F.lit(i)) for i in places])


def _validated(train, test, keys, vector, label, names, chosen, settings, scratch, **options) -> Validation:
    part = lambda df: None if df is None else df.withColumn(vector, slice_vector(vector, chosen))
    return cross_validate(part(train), part(test), keys, vector, label, [names[i] for i in chosen], settings, scratch, **options)


def evaluate_candidate(
    train: DataFrame, test: DataFrame | None, keys, vector: str, label: str, names: Sequence[str],
    chosen: Sequence[int], settings: BoostSettings, scratch: str, scoring: str, **options,
) -> dict:
    """Scores of a model on the chosen features: train, valid, ensemble, refit."""
    result = _validated(train, test, keys, vector, label, names, chosen, settings, scratch, **options)
    return {r["dataset"]: r[scoring] for r in M.fold_summary(result.scores, [scoring]).collect()}


def residual_gains(rows: DataFrame, vector: str, label: str, score: str, bins: int = 32, min_rows: int = 20) -> DataFrame:
    """(feature, gain): what the best split on each feature would still explain of what ``score`` leaves over.

    One aggregate for all features: sums of gradients and of their weights in equal-width bins.
    """
    y, p = F.col(label).cast("double"), F.col(score)
    long = rows.select((p - y).alias("_g"), (p * (1 - p)).alias("_h"), F.posexplode(vector).alias("feature", "value"))
    ends = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row per feature
    placed = long.join(F.broadcast(ends), "feature").withColumn("bin", bin_of(F.col("value"), F.col("low"), F.col("high"), F.lit(bins)))
    cells = placed.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("_g").alias("g"), F.sum("_h").alias("h"))
    left, whole = W.partitionBy("feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("feature")
    for name in "ngh":
        cells = cells.withColumn(f"l_{name}", F.sum(name).over(left)).withColumn(f"t_{name}", F.sum(name).over(whole))
    c = F.col
    ratio = lambda g, h: F.when(h > 0, g * g / h).otherwise(F.lit(0.0))
    gain = ratio(c("l_g"), c("l_h")) + ratio(c("t_g") - c("l_g"), c("t_h") - c("l_h")) - ratio(c("t_g"), c("t_h"))
    enough = (c("l_n") >= min_rows) & (c("t_n") - c("l_n") >= min_rows)
    return cells.groupBy("feature").agg(F.max(F.when(enough, gain).otherwise(F.lit(0.0))).alias("gain"))


def forward_selection(
    train: DataFrame, test: DataFrame | None, keys, vector: str, label: str, names: Sequence[str],
    settings: BoostSettings, scratch: str, scoring: str = "ACC", min_features: int = 1,
    max_features: int | None = None, candidates: Sequence[int] | None = None, parallelism: int = 4,
    shortlist: int | None = None, **options,
) -> DataFrame:
    """Greedy selection; one row per step: (step, feature, selected, train, valid, ensemble, refit scores).

    Every remaining feature is tried with the ones chosen so far and the best mean validation
    score is kept.  A score that does not improve ends the search once the minimum is reached.
    The score to beat starts at zero.

    With a ``shortlist`` every remaining feature is still looked at, by what its best split would explain of what the
    chosen ones leave over (out of fold, all features in one aggregate), and so many of the best are fitted.
    """
    left = list(range(len(names)) if candidates is None else candidates)
    most = len(left) if max_features is None else max_features
    data = cut(train)
    rest = data.withColumn("_p", F.lit(data.agg(F.avg(label)).first()[0]).cast("double"))
    chosen: list[int] = []
    current, steps = 0.0, []
    while left and len(chosen) < most:
        tried = left
        if shortlist is not None and shortlist < len(left):
            gains = dict(tuple(r) for r in residual_gains(rest, vector, label, "_p", min_rows=settings.min_rows).collect())  # one per feature
            tried = sorted(sorted(left, key=lambda i: names[i]), key=lambda i: -gains.get(i, 0.0))[:shortlist]

        def attempt(i):
            result = _validated(
                data, test, keys, vector, label, names, [*chosen, i], settings, f"{scratch}/step{len(chosen)}_{i}",
                written=True, **options,
            )
            return i, {r["dataset"]: r[scoring] for r in M.fold_summary(result.scores, [scoring]).collect()}, result

        with ThreadPool(parallelism) as pool:
            found = pool.map(attempt, tried)
        # the first of equal candidates in name order wins
        best, scores, result = max(found, key=lambda t: (t[1]["Valid"], [-ord(c) for c in names[t[0]]]))
        if scores["Valid"] <= current and len(chosen) >= min_features:
            break
        chosen.append(best)
        left.remove(best)
        current = scores["Valid"]
        if shortlist is not None:
            rest = data.join(result.train_predictions.select(*keys, F.col("p").alias("_p")), list(keys))
        steps.append(
            (len(chosen), names[best], [names[i] for i in chosen], scores.get("Train"), scores["Valid"],
             scores.get("Test_ensemble"), scores.get("Test_refit"))
        )
    schema = (
        "step int, feature string, selected array<string>, train_score double, valid_score double, "
        "test_ensemble_score double, test_refit_score double"
    )
    return train.sparkSession.createDataFrame(steps, schema)
