"""What each feature contributes to a prediction."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.dependence import matrix
from seqloom.operators.metrics import auroc_of_histograms
from seqloom.operators.ordinal import hash_ordinals
from seqloom.operators.quantiles import exact_quantiles
from seqloom.session import cut, spread_rows

#: Scores of an array of feature rows.
Scorer = Callable[[np.ndarray], np.ndarray]


def additive_terms(df: DataFrame, keys: Sequence[str], vector: str, stumps: DataFrame) -> DataFrame:
    """(keys, feature, value, term): per feature, the summed output of its stumps.

    ``stumps`` is (feature, cut, low, high): low where the value is at most the cut.
    Only features that have stumps are laid out.  A model's stump table is
    small and is broadcast.
    """
    per_feature = stumps.groupBy("feature").agg(F.collect_list(F.struct("cut", "low", "high")).alias("_stumps"))
    long = df.select(*keys, F.posexplode(vector).alias("feature", "value"))
    term = F.aggregate(
        "_stumps", F.lit(0.0), lambda acc, s: acc + F.when(F.col("value") <= s["cut"], s["low"]).otherwise(s["high"])
    )
    return long.join(F.broadcast(per_feature), "feature").select(*keys, "feature", "value", term.alias("term"))


def stump_attribution(df: DataFrame, keys: Sequence[str], vector: str, stumps: DataFrame) -> DataFrame:
    """Exact Shapley values of an additive model: a feature's term minus its mean.

    The means are one number per feature, so they are added up first and
    broadcast back; no window gathers a feature's rows in one place.
    """
    terms = additive_terms(df, keys, vector, stumps)
    means = terms.groupBy("feature").agg(F.avg("term").alias("_mean"))
    return terms.join(F.broadcast(means), "feature").select(
        *keys, "feature", "value", (F.col("term") - F.col("_mean")).alias("attribution")
    )


def global_importance(attributions: DataFrame, top: int = 20) -> DataFrame:
    """Features ranked by mean absolute attribution."""
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
        .limit(top)
    )


def attribution_distribution(attributions: DataFrame) -> DataFrame:
    """Quartiles of the attribution per feature, exact."""
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return exact_quantiles(attributions, ["feature"], "attribution", shares)


def stump_scorer(stumps: DataFrame) -> Scorer:
    """The additive model of a stump table, as a function of feature arrays; the table is as long as the model."""
    rows = [tuple(r) for r in stumps.select("feature", "cut", "low", "high").collect()]

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut_, low, high in rows:
            total += np.where(x[:, feature] <= cut_, low, high)
        return total

    return score


def background(df: DataFrame, keys: Sequence[str], vector: str, rows: int, seed: int = 42) -> np.ndarray:
    """A fixed number of rows that stand for all: those with the smallest digests of their keys."""
    digest = F.md5(F.concat(*[F.concat(F.col(k).cast("string"), F.lit(":")) for k in keys], F.lit(str(seed))))
    return matrix(df.orderBy(digest, *keys).limit(rows).select(F.col(vector).cast("array<double>")).toArrow().column(0))


#: Numbers that are laid out to be scored together.
LAID_OUT = 1 << 21


class Paths:
    """Orders in which players switch from a background row's values to a row's own, each with its reverse."""

    def __init__(self, players: Sequence[Sequence[int]], permutations: int, seed: int):
        if permutations < 2 or permutations % 2:
            raise ValueError("an even number of orders is needed, as each comes with its reverse")
        draw = random.Random(seed)
        some = [draw.sample(range(len(players)), len(players)) for _ in range(permutations // 2)]
        self.orders = [o for order in some for o in (order, order[::-1])]
        self.players = players

    def own(self, order: Sequence[int], width: int) -> np.ndarray:
        """steps x features: whether a feature has the row's own value after so many switches."""
        out = np.zeros((len(order) + 1, width), bool)
        for step, player in enumerate(order):
            out[step + 1 :, list(self.players[player])] = True
        return out

    def gains(self, x: np.ndarray, z: np.ndarray, predict: Scorer) -> np.ndarray:
        """rows x background x pairs of orders x players: what a player's switch changes, the mean of both orders."""
        n, width = x.shape
        out = np.zeros((n, len(z), len(self.orders) // 2, len(self.players)))
        for o, order in enumerate(self.orders):
            own = self.own(order, width)
            points = np.where(own, x[:, None, None, :], z[None, :, None, :]).reshape(-1, width)
            steps = np.diff(predict(points).reshape(n, len(z), len(order) + 1), axis=2)
            out[:, :, o // 2, order] += steps / 2
        return out


def sampled_attribution(
    df: DataFrame,
    keys: Sequence[str],
    vector: str,
    predict: Scorer,
    players: Sequence[Sequence[int]],
    background_rows: int = 100,
    permutations: int = 8,
    seed: int = 42,
) -> DataFrame:
    """(keys, player, attribution, error): Shapley values sampled over seeded orders and background rows.

    ``predict`` scores an array of feature rows.  ``players`` are groups of feature places; one feature each for plain
    attribution, whole groups for the grouped form.  A row's players switch from a background row's to the row's own
    values one after another, and the change of the prediction is credited to the player that switched; every
    order is also run backwards.  All steps of some rows are scored in one call where the rows are, and one
    row per player leaves the task.  ``error`` is the standard error over background rows and pairs of orders.
    """
    z = df.sparkSession.sparkContext.broadcast(background(df, keys, vector, background_rows, seed))
    paths = Paths(players, permutations, seed)
    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_players = len(players)
        for batch in batches:
            x = matrix(batch.column("_x"))
            step = max(1, LAID_OUT // max(1, z.value.size * (n_players + 1)))
            for start in range(0, len(x), step):
                part = batch.slice(start, step)
                gains = paths.gains(x[start : start + step], z.value, predict).reshape(part.num_rows, -1, n_players)
                n = gains.shape[1]
                error = gains.std(axis=1, ddof=1) / np.sqrt(n) if n > 1 else np.zeros((part.num_rows, n_players))
                which = pa.array(np.repeat(np.arange(part.num_rows), n_players))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(which) for k in keys], pa.array(np.tile(np.arange(n_players, dtype=np.int32), part.num_rows)),
                     pa.array(gains.mean(axis=1).ravel()), pa.array(error.ravel())],
                    [*keys, "player", "attribution", "error"],
                )

    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("_x"))
    return spread_rows(rows).mapInArrow(task, schema + "player int, attribution double, error double")


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, of which the leading 16 bits make bins."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 48


def permutation_importance(
    df: DataFrame,
    key: str,
    vector: str,
    label: str,
    predict: Scorer,
    features: Sequence[int],
    seed: int = 42,
) -> DataFrame:
    """(feature, drop): how much the AUROC falls when a feature's values change rows.

    Rows are numbered in two independent hash orders; a row receives the value of the row that has its number in the
    other order.  A task puts one foreign value at a time into its rows, scores them, and takes it out again, so
    what leaves it is a histogram of scores per feature: bins, and in them the scores with how many rows of
    either label have them.  Rows are not copied.
    """
    base = cut(df.select(key, F.col(vector).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_y")))
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    plain = hash_ordinals(base.withColumn("_d", F.md5(F.col(key).cast("string"))), [], "_d", [key], name="_at").drop("_d")
    other = hash_ordinals(base.withColumn("_d", digest), [], "_d", [key], name="_at").select("_at", F.col("_x").alias("_other"))
    partners = plain.join(other, "_at").select("_x", "_other", "_y")
    whole = -1  # stands for no feature

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, foreign = matrix(batch.column("_x")).copy(), matrix(batch.column("_other"))
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for f in (whole, *features):
                if f != whole:
                    own = x[:, f].copy()
                    x[:, f] = foreign[:, f]
                score, at = np.unique(predict(x), return_inverse=True)
                if f != whole:
                    x[:, f] = own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), f, np.int32)), pa.array(_ordered_bits(score)), pa.array(score),
                     pa.array(np.bincount(at, y == 1, len(score)).astype(np.int64)),
                     pa.array(np.bincount(at, y == 0, len(score)).astype(np.int64))],
                    ["feature", "bin", "score", "pos", "neg"],
                )

    histograms = cut(partners.mapInArrow(task, "feature int, bin long, score double, pos long, neg long"))
    found = cut(auroc_of_histograms(histograms, ["feature"]))
    base_line = found.filter(F.col("feature") == whole).select(F.col("AUROC").alias("_base"))
    changed = found.filter(F.col("feature") != whole)
    return changed.crossJoin(F.broadcast(base_line)).select("feature", (F.col("_base") - F.col("AUROC")).alias("drop"))
