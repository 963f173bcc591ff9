"""How strongly features depend on each other, from rows that hold a feature array.

Every measure here is a function of sums over rows of products of two features (or
of their bins).  Each task multiplies its own rows as matrices and emits one partial
sum per feature pair; the partial sums are added up by Spark.  So the rows are read
once, no row is ever paired with another, and what is shuffled depends on the number of
features only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordinal import average_ranks
from seqloom.operators.quantiles import auto_bins, skewed_lookup
from seqloom.session import cut

METHODS = ["pearson", "spearman", "mutual_info", "model_based"]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def long_features(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, feature, value) with the feature's place in the array."""
    return df.select(key, F.posexplode(vector).alias("feature", "value"))


def pairs_of(names: Sequence[str] | int, spark) -> DataFrame:
    """All feature pairs i < j of a dimension table."""
    n = names if isinstance(names, int) else len(names)
    i = spark.range(n).select(F.col("id").cast("int").alias("feature_i"))
    later = F.sequence(F.col("feature_i") + 1, F.lit(n - 1))
    return i.filter(F.col("feature_i") < n - 1).select("feature_i", F.explode(later).alias("feature_j"))


def _products(df: DataFrame, vector: str, shift: list[float]) -> DataFrame:
    """(feature_i, feature_j, s): sums over rows of shifted products, added up over tasks."""
    centre = np.array(shift)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0)) - centre if batch.num_rows else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            p = total.shape[0]
            i, j = np.meshgrid(np.arange(p, dtype="int32"), np.arange(p, dtype="int32"), indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["feature_i", "feature_j", "s"]
            )

    parts = df.select(vector).mapInArrow(partial, "feature_i int, feature_j int, s double")
    return parts.groupBy("feature_i", "feature_j").agg(F.sum("s").alias("s"))


def _correlation(df: DataFrame, vector: str) -> DataFrame:
    # one mean per feature: as many numbers as the array is long
    means = df.select(F.posexplode(vector).alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m")).orderBy("f").collect()
    s = cut(_products(df, vector, [r["m"] for r in means]))
    spread = s.filter("feature_i = feature_j").select(F.col("feature_i").alias("f"), F.col("s").alias("v"))
    left = spread.select(F.col("f").alias("feature_i"), F.col("v").alias("vi"))
    right = spread.select(F.col("f").alias("feature_j"), F.col("v").alias("vj"))
    scale = F.sqrt(F.col("vi")) * F.sqrt(F.col("vj"))
    return (
        s.join(left, "feature_i")
        .join(right, "feature_j")
        .select("feature_i", "feature_j", F.when(scale > 0, F.col("s") / scale).alias("value"))
    )


def pearson(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(feature_i, feature_j, value): linear correlation of every two features."""
    return _correlation(df, vector)


def spearman(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Correlation of average ranks."""
    long = long_features(df, key, vector)
    ranks = average_ranks(long, ["feature"], "value").select("feature", "value", "avg_rank")
    ranked = skewed_lookup(long, ranks, ["feature", "value"])
    rows = ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("feature", "avg_rank"))), lambda c: c["avg_rank"]).alias("_r")
    )
    return _correlation(cut(rows), "_r")


#: Bin numbers that a task holds before it counts them.
HELD = 4 << 20


def _pair_counts(df: DataFrame, vector: str, low: np.ndarray, span: np.ndarray, bins: np.ndarray) -> DataFrame:
    """(cell, n): how many rows have two features in two bins, for features i <= j and bins that occur together.

    A cell is the number of the pair of features and, within, of the pair of bins.  A task holds the bin numbers of some rows,
    and counts a pair of features at a time.
    """
    p, room = len(bins), int(bins.max()) ** 2
    names = ["cell", "n"]

    def counted(place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(p):
            cells, counts = [], []
            for j in range(i, p):
                code = place[i] * bins[j] + place[j]
                if bins[i] * bins[j] <= 4 * len(code):
                    n = np.bincount(code)
                    there = np.flatnonzero(n)
                    n = n[there]
                else:
                    there, n = np.unique(code, return_counts=True)
                cells.append((i * p + j) * room + there)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(counts))], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            scaled = np.divide(x - low, span, out=np.zeros_like(x), where=span > 0)
            held.append(np.minimum(np.floor(scaled * bins), bins - 1).astype(np.int64).T)
            size += x.size
            if size >= HELD:
                yield from counted(np.concatenate(held, axis=1))
                held, size = [], 0
        if held:
            yield from counted(np.concatenate(held, axis=1))

    parts = df.select(vector).mapInArrow(task, "cell long, n long")
    total = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    pair = F.expr(f"cell div {room}")
    return total.select((pair / p).cast("int").alias("feature_i"), (pair % p).cast("int").alias("feature_j"), "n")


def mutual_information(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Normalized mutual information of the binned features; 1 on the diagonal, 0 with a feature that does not vary.

    It is what two entropies leave over the joint one, and entropies are sums over the cells that occur: no table of all
    pairs of bins is made.
    """
    layout = auto_bins(long_features(df, key, vector), ["feature"], "value").orderBy("feature").collect()
    low = np.array([r["low"] for r in layout])
    span = np.array([r["high"] - r["low"] for r in layout])
    bins = np.array([r["bins"] for r in layout])
    rows = float(layout[0]["n_rows"])
    cells = _pair_counts(df, vector, low, span, bins)
    entropy = (math.log(rows) - F.sum(F.col("n") * F.log("n")) / rows).alias("h")
    joint = cut(cells.groupBy("feature_i", "feature_j").agg(entropy))
    single = joint.filter("feature_i = feature_j")
    left = single.select("feature_i", F.col("h").alias("hi"))
    right = single.select("feature_j", F.col("h").alias("hj"))
    shared = F.col("hi") + F.col("hj") - F.col("h")
    both = F.col("hi") * F.col("hj")
    value = F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / F.sqrt(both)))).otherwise(F.lit(0.0))
    upper = joint.filter("feature_i < feature_j").join(left, "feature_i").join(right, "feature_j")
    return _mirror(upper.select("feature_i", "feature_j", value.alias("value")), len(bins))


def _mirror(upper: DataFrame, p: int) -> DataFrame:
    """Both halves and a diagonal of ones."""
    lower = upper.select(F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "value")
    ids = upper.sparkSession.range(p).select(F.col("id").cast("int").alias("feature_i"))
    diagonal = ids.select("feature_i", F.col("feature_i").alias("feature_j"), F.lit(1.0).alias("value"))
    return upper.unionByName(lower).unionByName(diagonal)


def model_dependence(df: DataFrame, key: str, vector: str, fold: str, num_folds: int = 10, bins: int = 10) -> DataFrame:
    """Mean cross-validated R2 of predicting one feature from the other, both ways, clipped at zero.

    The predictor is the mean of y within equal-width bins of x over the other folds;
    a bin they never saw predicts their overall mean.
    """
    ends = (
        df.select(F.posexplode(vector).alias("f", "v")).groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("f").collect()
    )
    low = np.array([r["lo"] for r in ends])
    span = np.array([r["hi"] - r["lo"] for r in ends])
    p = len(ends)

    def partial(batches):
        counts, sums = np.zeros((num_folds, p * bins)), np.zeros((num_folds, p * bins, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column(0).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(1))
            scaled = np.divide(x - low, span, out=np.zeros_like(x), where=span > 0)
            place = np.minimum(np.floor(scaled * bins), bins - 1).astype("int64") + np.arange(p) * bins
            for f in np.unique(which):
                rows, at = x[which == f], place[which == f]
                for start in range(0, len(rows), 4096):
                    part, values = at[start : start + 4096], rows[start : start + 4096]
                    hot = np.zeros((len(part), p * bins))
                    hot[np.arange(len(part))[:, None], part] = 1
                    counts[f] += hot.sum(axis=0)
                    sums[f] += hot.T @ values
        f, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(f.astype("int32")),
                pa.array((cell // bins).astype("int32")),
                pa.array((cell % bins).astype("int32")),
                pa.array(counts[f, cell]),
                pa.array(list(sums[f, cell]), type=pa.list_(pa.float64())),
            ],
            ["fold", "x", "bin", "n", "sums"],
        )

    parts = df.select(F.col(fold).cast("int"), vector).mapInArrow(
        partial, "fold int, x int, bin int, n double, sums array<double>"
    )
    cells = parts.select("fold", "x", "bin", "n", F.posexplode("sums").alias("y", "s"))
    cells = cells.filter("x <> y").groupBy("fold", "x", "bin", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cells = cut(cells)
    squares = _fold_squares(df, vector, fold)
    per_fold = cells.groupBy("fold", "x", "y").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    whole = per_fold.groupBy("x", "y").agg(F.sum("fn").alias("tn"), F.sum("fs").alias("ts"))
    per_bin = cells.groupBy("x", "bin", "y").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    c = F.col
    rest_n, rest_s = c("bn") - c("n"), c("bs") - c("s")
    fallback = (c("ts") - c("fs")) / (c("tn") - c("fn"))
    guess = F.when(rest_n > 0, rest_s / rest_n).otherwise(fallback)
    scored = (
        cells.join(per_bin, ["x", "bin", "y"])
        .join(per_fold, ["fold", "x", "y"])
        .join(whole, ["x", "y"])
        .withColumn("_g", guess)
        .groupBy("fold", "x", "y", "fn", "fs")
        .agg(F.sum(c("_g") * c("_g") * c("n") - 2 * c("_g") * c("s")).alias("part"))
        .join(squares, ["fold", "y"])
    )
    sst = c("q") - c("fs") * c("fs") / c("fn")
    r2 = scored.select("fold", "x", "y", F.when(sst > 0, 1 - (c("q") + c("part")) / sst).alias("r2"))
    one_way = r2.groupBy("x", "y").agg(F.greatest(F.lit(0.0), F.avg("r2")).alias("v"))
    upper = one_way.select(F.least("x", "y").alias("feature_i"), F.greatest("x", "y").alias("feature_j"), "v")
    upper = upper.groupBy("feature_i", "feature_j").agg(F.avg("v").alias("value"))
    return _mirror(upper, p)


def _fold_squares(df: DataFrame, vector: str, fold: str) -> DataFrame:
    """Per fold and feature, the sum of squares."""
    long = df.select(F.col(fold).cast("int").alias("fold"), F.posexplode(vector).alias("y", "v"))
    return long.groupBy("fold", "y").agg(F.sum(F.col("v") * F.col("v")).alias("q"))


def redundancy(df: DataFrame, key: str, vector: str, method: str = "pearson", fold: str | None = None) -> DataFrame:
    """One of the four measures by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; expected one of {METHODS}")
    if method == "model_based":
        from seqloom.operators.folds import NUM_FOLDS, SEED, _digest
        from seqloom.operators.ordinal import hash_ordinals

        if fold is None:
            dealt = hash_ordinals(df.withColumn("_d", _digest([key], SEED)), [], "_d", [key], name="_o")
            df, fold = dealt.withColumn("_fold", ((F.col("_o") - 1) % NUM_FOLDS).cast("int")), "_fold"
        return model_dependence(df, key, vector, fold)
    return {"pearson": pearson, "spearman": spearman, "mutual_info": mutual_information}[method](df, key, vector)


def dependence_distance(values: DataFrame) -> DataFrame:
    return values.withColumn("value", 1 - F.abs("value"))


def feature_groups(values: DataFrame, cutoff: float = 0.95) -> DataFrame:
    """(feature, group): features linked, directly or through others, by |value| >= cutoff.

    Each feature takes the smallest label among its neighbours, then the label of that
    label, until nothing changes; every round is cut, so the plan does not grow.
    """
    strong = values.filter((F.abs("value") >= cutoff) & (F.col("feature_i") != F.col("feature_j")))
    edges = cut(
        strong.select("feature_i", "feature_j")
        .unionByName(strong.select(F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j")))
        .distinct()
    )
    nodes = values.select(F.col("feature_i").alias("feature")).distinct()
    labels = cut(nodes.withColumn("group", F.col("feature")))
    while True:
        offered = edges.join(labels, edges.feature_j == labels.feature).groupBy(F.col("feature_i").alias("feature")).agg(
            F.min("group").alias("_offer")
        )
        nearer = labels.join(offered, "feature", "left").select(
            "feature", "group", F.least("group", F.coalesce("_offer", "group")).alias("_new")
        )
        beyond = labels.select(F.col("feature").alias("_new"), F.col("group").alias("_far"))
        step = cut(nearer.join(beyond, "_new").select("feature", F.col("group").alias("_old"), F.least("_new", "_far").alias("group")))
        if step.filter(F.col("_old") != F.col("group")).isEmpty():
            return labels
        labels = step.select("feature", "group")
