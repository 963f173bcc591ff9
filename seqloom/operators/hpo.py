"""Model families and the search over their settings."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import metrics as M
from seqloom.operators import neighbours as N
from seqloom.operators.models import MOST_FITS, refuse_many
from seqloom.operators.scaling import fit_vector_scaler
from seqloom.session import cut


def logistic_l2(n: int, d: int, C: float = 1.0, **kw):
    """L2 logistic; the penalty's weight is 1 / (C n)."""
    return LogisticRegression(elasticNetParam=0.0, regParam=1 / (C * n), standardization=False, **kw)


def logistic_l1(n: int, d: int, C: float = 1.0, **kw):
    return LogisticRegression(elasticNetParam=1.0, regParam=1 / (C * n), standardization=False, **kw)


def svm(n: int, d: int, C: float = 1.0, degree: int = 1, **kw):
    """Linear margin classifier; a degree of 2 or 3 expands the features first."""
    linear = LinearSVC(regParam=1 / (C * n), standardization=False, featuresCol="expanded" if degree > 1 else "features", **kw)
    if degree == 1:
        return linear
    return Pipeline(stages=[PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded"), linear])


def mlp(n: int, d: int, hidden: Sequence[int] = (100,), step: float = 0.03, iterations: int = 100, seed: int = 0):
    return MultilayerPerceptronClassifier(layers=[d, *hidden, 2], stepSize=step, maxIter=iterations, seed=seed)


def random_forest(
    n: int, d: int, trees: int = 100, depth: int = 5, features: str | float = "sqrt", leaves: int | None = None, rows: int = 1,
    seed: int = 0,
):
    """A number of leaves becomes the depth that a balanced tree of as many leaves has."""
    if leaves is not None:
        depth = max(1, math.ceil(math.log2(leaves)))
    share = features if isinstance(features, str) else f"{features:.3f}"
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=share, minInstancesPerNode=rows, seed=seed
    )


def boosted(n: int, d: int, trees: int = 100, leaves: int = 31, step: float = 0.1, share: float = 1.0, seed: int = 0):
    """One boosted family stands for the three histogram libraries; leaves become a depth."""
    depth = max(1, math.ceil(math.log2(leaves)))
    return GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=step, featureSubsetStrategy="all" if share >= 1 else f"{share:.3f}", seed=seed
    )


FAMILIES: dict[str, Callable] = {
    "logistic_l2": logistic_l2,
    "logistic_l1": logistic_l1,
    "svm": svm,
    "mlp": mlp,
    "random_forest": random_forest,
    "boosted": boosted,
}

# The published settings each family is searched over ("log" draws log-uniformly), as far as Spark has the
# setting.  It has no choice of activation, weight decay or step schedule for networks, no unlimited leaves (the 1,000
# stand for them), and one boosted family.  Searches draw DRAWS settings and use FOLDS folds where nothing else is asked.
DRAWS, FOLDS = 100, 5
SPACES: dict[str, dict] = {
    "knn": {"k": [5, 10, 15, 25, 50, 100, 250, 500], "weights": ["uniform", "distance"], "p": [1, 2]},
    "logistic_l2": {"C": [10 ** (-5 + 8 * i / 99) for i in range(100)]},
    "logistic_l1": {"C": [10 ** (-5 + 8 * i / 99) for i in range(100)]},
    "svm": {"C": [10 ** (-2 + 5 * i / 9) for i in range(10)], "degree": [1, 2, 3]},
    "mlp": {
        "hidden": [(50,), (100,), (200,), (100, 50), (200, 100), (300, 150), (100, 50, 25), (200, 100, 50), (300, 200, 100)],
        "step": ("log", 1e-4, 1e-1),
    },
    "random_forest": {
        "features": ["sqrt", "log2", 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
        "leaves": [10, 100, 1000],
        "rows": [1, 2, 5, 10, 20, 50, 100],
    },
    "boosted": {
        "trees": [3, 10, 30, 100, 200, 300],
        "leaves": [2, 4, 8, 12, 16, 24, 31, 32, 48, 64, 96, 128],
        "step": ("log", 0.01, 1),
        "share": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    },
}


def grid(space: dict) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(space, combo)) for combo in itertools.product(*space.values())]


def random_draws(space: dict, n: int = DRAWS, seed: int = 0) -> list[dict]:
    """``n`` seeded draws: one of a list, or log-uniform between two bounds."""
    draw = random.Random(seed)

    def one(choice):
        if isinstance(choice, tuple) and choice and choice[0] == "log":
            return math.exp(draw.uniform(math.log(choice[1]), math.log(choice[2])))
        return draw.choice(choice)

    return [{name: one(choice) for name, choice in space.items()} for _ in range(n)]


def fit_predict(family: str, setting: dict, train: DataFrame, held: DataFrame) -> DataFrame:
    """(id, _y, p) of the held rows under a model fitted on the others.

    Gaps are filled and features scaled by the training rows alone.
    """
    return _fit_predict(family, setting, *_scaled(train, held))


def _scaled(train: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Both sides on the training rows' scale, and the training side's rows and features."""
    scale = fit_vector_scaler(train, "_x")
    shape = train.agg(F.count("*"), F.max(F.size("_x"))).first()
    return train.withColumn("_x", scale("_x")), held.withColumn("_x", scale("_x")), (shape[0], shape[1])


def _fit_predict(family: str, setting: dict, train: DataFrame, held: DataFrame, shape: tuple[int, int]) -> DataFrame:
    if family == "knn":
        scored = N.knn_classify(held, train, setting["k"], "id", "_x", "_y", setting["weights"], setting["p"])
        return held.select("id", "_y").join(scored.select(F.col("query_id").alias("id"), F.col("p1").alias("p")), "id")
    rows = train.select(array_to_vector("_x").alias("features"), F.col("_y").cast("double").alias("label"))
    model = FAMILIES[family](*shape, **setting).fit(rows)
    out = model.transform(held.withColumn("features", array_to_vector("_x")))
    if "probability" in out.columns:
        p = F.get(vector_to_array("probability"), F.lit(1))
    else:
        # a margin has no probability; its sign decides, and its logistic keeps the order
        p = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return out.select("id", "_y", p.alias("p"))


def search(
    df: DataFrame, key: str, vector: str, label: str, fold: str, family: str, settings: Sequence[dict],
    parallelism: int = 4, ledger: str | None = None,
) -> DataFrame:
    """(model, setting, params, fold, metrics...) for every setting and fold.

    What depends on the fold only - the scale, the row count, the scaled rows - is made once per fold.  A ``ledger`` is a
    folder of finished reports: each is written as soon as it is known, and a search that is started again with the
    same ledger fits only what is not there.
    """
    data = cut(
        df.select(F.col(key).alias("id"), F.col(vector).alias("_x"), F.col(label).alias("_y"), F.col(fold).alias("fold"))
    )
    folds = sorted(r[0] for r in data.select("fold").distinct().limit(MOST_FITS + 1).collect())
    refuse_many(len(folds))

    def prepared(f):
        train, held, shape = _scaled(data.filter(F.col("fold") != f), data.filter(F.col("fold") == f))
        return cut(train), cut(held), shape

    sides = {f: prepared(f) for f in folds}

    def one(job):
        i, f = job
        scored = _fit_predict(family, settings[i], *sides[f])
        return scored.select("_y", "p", F.lit(i).alias("setting"), F.lit(f).alias("fold"))

    jobs = [(i, f) for i in range(len(settings)) for f in folds]
    text = F.array(*[F.lit(str(s)) for s in settings])
    columns = [F.lit(family).alias("model"), "setting", F.get(text, F.col("setting")).alias("params"), "fold", *M.ALL_METRICS]
    if ledger is not None:
        return _with_ledger(df.sparkSession, ledger, family, [str(s) for s in settings], jobs, one, columns, parallelism)
    with ThreadPool(parallelism) as pool:
        parts = pool.map(one, jobs)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return M.metric_report(cut(rows), ["setting", "fold"], "_y", "p").select(*columns)


def _with_ledger(spark, ledger: str, family: str, settings: Sequence[str], jobs, one, columns, parallelism: int) -> DataFrame:
    """Reports of all jobs, of which those in the ledger are not made again; a report is a folder of its own."""
    folder = f"{ledger.rstrip('/')}/{family}"
    place = lambda job: f"{hashlib.md5(settings[job[0]].encode()).hexdigest()}-{job[1]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
    finished = {n for n in there if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))}

    def write(job):
        report = M.metric_report(cut(one(job)), ["setting", "fold"], "_y", "p")
        report.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{place(job)}")

    with ThreadPool(parallelism) as pool:
        pool.map(write, [j for j in jobs if place(j) not in finished])
    return spark.read.parquet(*[f"{folder}/{place(j)}" for j in jobs])


def best_setting(results: DataFrame) -> DataFrame:
    """(model, setting, params, mean and population deviation of each metric), the best mean MCC per model."""
    aggs = [f(m).alias(f"{m}_{n}") for m in M.ALL_METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    means = results.groupBy("model", "setting", "params").agg(*aggs)
    best = means.groupBy("model").agg(F.min(F.struct((-F.col("MCC_mean")).alias("s"), "setting")).alias("_b"))
    return means.join(best.select("model", F.col("_b.setting").alias("setting")), ["model", "setting"], "left_semi")
