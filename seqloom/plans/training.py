"""Queries that fit models; checked by schema, row counts and the tests' properties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from seqloom.operators import attribution as A
from seqloom.operators import dependence as D
from seqloom.operators import folds as K
from seqloom.operators import hpo as H
from seqloom.operators import models as B
from seqloom.operators import selected as X
from seqloom.plans.base import labeled, query, r6
from seqloom.plans.features import emb
from seqloom.plans.modelling import scratch
from seqloom.session import cut
from seqloom.sources.tables import read_table

# small settings, so that a check takes seconds; the defaults are in BoostSettings
SETTINGS = B.BoostSettings(iterations=6, depth=3, min_rows=5, patience=3, positive_weight=1.0, bins=64)


def labeled_vectors(spark, folder):
    """(doc_id, features, y, fold): the selected features of every labeled text."""
    rows = cut(X.counted_vector(labeled(spark, folder)).select("doc_id", F.col("quality").alias("y"), "features"))
    return cut(K.stratified_folds(rows, ["doc_id"], "y", 3))


def split(spark, folder):
    """Train on one half of the classes of the vectors, test on the other half."""
    rows = K.stratified_folds(emb(spark, folder).drop("label"), ["vec_id"], "y", 4)
    rows = cut(rows)
    return rows.filter("fold < 3"), rows.filter("fold = 3")


EMB_NAMES = [f"x{i}" for i in range(64)]


@query("train_boosted")
def train_boosted(spark, folder):
    rows = labeled_vectors(spark, folder)
    forest = B.Forest.of(B.tree_nodes(spark, B.train_boosted(rows, "features", "y", SETTINGS), scratch(spark)))
    return rows.select("doc_id", "y", forest.score("features").alias("p"))


@query("train_stumps")
def train_stumps(spark, folder):
    model = B.train_stumps(emb(spark, folder), "x", "y", SETTINGS)
    return B.stump_table(B.tree_nodes(spark, model, scratch(spark)))


@query("cross_validate")
def cross_validate(spark, folder):
    train, test = split(spark, folder)
    result = B.cross_validate(train, test, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit_multiplier=1.1)
    return result.scores


@query("out_of_fold")
def out_of_fold(spark, folder):
    train, _ = split(spark, folder)
    result = B.cross_validate(train, None, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit=False)
    return result.train_predictions


@query(
    "early_stopping",
    "WITH sc AS (SELECT event_type AS fold, CAST(hour(ts)*60+minute(ts) AS INTEGER) AS iteration, avg(value) AS metric FROM events GROUP BY 1,2), "
    "cv AS (SELECT iteration, round(avg(metric),9) AS mean FROM sc GROUP BY 1), "
    "rc AS (SELECT *, max(mean) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cv), "
    "rr AS (SELECT iteration, mean, lead(iteration) OVER (ORDER BY iteration) AS nx FROM rc WHERE best IS NULL OR mean > best) "
    "SELECT iteration, round(mean,6) AS mean FROM rr WHERE nx IS NULL OR nx-iteration > 20 ORDER BY iteration LIMIT 1",
)
def early_stopping(spark, folder):
    """The stopping rule on a curve: event types as folds, minutes of the day as iterations."""
    rows = read_table(spark, folder, "events").select(
        F.col("event_type").alias("fold"), (F.hour("ts") * 60 + F.minute("ts")).alias("iteration"), "value"
    )
    curve = rows.groupBy("fold", "iteration").agg(F.avg("value").alias("metric"))
    return B.best_iteration(curve, 20).select("iteration", r6("mean"))


@query("refit")
def refit(spark, folder):
    train, test = split(spark, folder)
    result = B.cross_validate(train, test, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit_multiplier=1.5)
    return test.select("vec_id", "y", result.refit_forest.score("x").alias("p"))


@query("predict")
def predict(spark, folder):
    train, test = split(spark, folder)
    result = B.cross_validate(train, test, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit=False)
    return result.test_predictions


@query("split_gain_importance")
def split_gain_importance(spark, folder):
    train, _ = split(spark, folder)
    result = B.cross_validate(train, None, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit=False)
    return result.importances


@query("fold_importances")
def fold_importances(spark, folder):
    """Splits, gains and mean absolute attributions on the training, held-out and test rows of every fold."""
    train, test = split(spark, folder)
    result = B.cross_validate(train, test, ["vec_id"], "x", "y", EMB_NAMES, SETTINGS, scratch(spark), refit=False)
    return B.fold_importances(result)


@query("save_load_model")
def save_load_model(spark, folder):
    path = scratch(spark)
    rows = emb(spark, folder)
    B.save_model(B.train_stumps(rows, "x", "y", SETTINGS), path, 4)
    model, facts = B.load_model(spark, path)
    forest = B.Forest.of(B.tree_nodes(spark, model, path + "/nodes"))
    return rows.select("vec_id", forest.score("x", facts["best_iteration"]).alias("p"))


@query("evaluate_candidate")
def evaluate_candidate(spark, folder):
    train, test = split(spark, folder)
    scores = B.evaluate_candidate(
        train, test, ["vec_id"], "x", "y", EMB_NAMES, [0, 5, 9], replace(SETTINGS, iterations=3, depth=1), scratch(spark), "AUROC"
    )
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(scores.items())], "dataset string, value double")


@query("forward_selection")
def forward_selection(spark, folder):
    """All 64 features are candidates in every step; the three that would explain most are fitted."""
    train, test = split(spark, folder)
    return B.forward_selection(
        train, test, ["vec_id"], "x", "y", EMB_NAMES, replace(SETTINGS, iterations=3, depth=1), scratch(spark), "AUROC",
        max_features=2, shortlist=3,
    )


FAMILY_SETTINGS = {
    "knn": [{"k": 5, "weights": "distance", "p": 1}],
    "logistic_l2": [{"C": 1.0}],
    "logistic_l1": [{"C": 1.0}],
    "svm": [{"C": 1.0, "degree": 1, "maxIter": 10}],
    "mlp": [{"hidden": (4,), "iterations": 20}],
    "random_forest": [{"trees": 5, "depth": 3}],
    "boosted": [{"trees": 3, "leaves": 4}],
}


def register_family(family: str):
    @query(f"family_{family}")
    def run(spark, folder):
        rows = K.stratified_folds(emb(spark, folder), ["vec_id"], "y", 2)
        return H.search(rows, "vec_id", "x", "y", "fold", family, FAMILY_SETTINGS[family])


for _family in FAMILY_SETTINGS:
    register_family(_family)


@query("grid_search")
def grid_search(spark, folder):
    rows = K.stratified_folds(emb(spark, folder), ["vec_id"], "y", 2)
    results = H.search(rows, "vec_id", "x", "y", "fold", "logistic_l2", H.grid({"C": [0.01, 1.0, 100.0]}))
    return H.best_setting(results)


@query("random_search")
def random_search(spark, folder):
    rows = K.stratified_folds(emb(spark, folder), ["vec_id"], "y", 2)
    space = {"trees": [3, 5], "leaves": [2, 4], "step": ("log", 0.01, 1)}
    return H.best_setting(H.search(rows, "vec_id", "x", "y", "fold", "boosted", H.random_draws(space, 2, 0)))


@query("model_stump_attribution")
def model_stump_attribution(spark, folder):
    """Exact attributions of a trained two-leaf model."""
    rows = emb(spark, folder)
    model = B.train_stumps(rows, "x", "y", SETTINGS)
    stumps = cut(B.stump_table(B.tree_nodes(spark, model, scratch(spark))))
    return A.stump_attribution(rows, ["vec_id"], "x", stumps)
