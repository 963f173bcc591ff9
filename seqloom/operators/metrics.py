"""Classification and regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordinal import running_totals


def threshold_label(score: Column | str, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold (the threshold itself counts)."""
    s = F.col(score) if isinstance(score, str) else score
    return (s >= threshold).cast("int")


def confusion(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """tn, fp, fn, tp per group."""

    def cell(y: int, p: int) -> Column:
        return F.sum(F.when((F.col(label) == y) & (F.col(predicted) == p), 1).otherwise(0))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def accuracy() -> Column:
    return _ratio(_d("tp") + _d("tn"), _d("tp") + _d("tn") + _d("fp") + _d("fn"))


def sensitivity() -> Column:
    return _or_zero(_d("tp"), _d("tp") + _d("fn"))


def specificity() -> Column:
    return _or_zero(_d("tn"), _d("tn") + _d("fp"))


def mcc() -> Column:
    """Matthews correlation; zero when a margin is empty."""
    tp, tn, fp, fn = _d("tp"), _d("tn"), _d("fp"), _d("fn")
    return _or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def fbeta(beta: float) -> Column:
    b2 = beta * beta
    hits = (1 + b2) * _d("tp")
    return _or_zero(hits, hits + b2 * _d("fn") + _d("fp"))


def f1() -> Column:
    return fbeta(1.0)


def auroc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Rank statistic with tied scores sharing their average rank; null for a single class.

    Rows collapse to one per distinct score first.  Each positive then beats the
    negatives that score lower, and half of those that score the same.
    """
    y = F.col(label)
    ties = df.groupBy(*by, score).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("_neg")
    )
    return _auroc_of_ties(ties, by, score)


def _auroc_of_ties(ties: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    placed = running_totals(ties, by, [score], {"_lower": "_neg"})
    wins = F.sum(F.col("_pos") * (F.col("_lower") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return placed.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("AUROC"))


def auroc_of_histograms(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """As `auroc`, of (by, bin, score, pos, neg): counts that tasks have made, bins being in the order of the scores.

    A bin in which one label alone occurs is one row, whatever its scores are; only the others are taken apart.
    """
    bins = parts.groupBy(*by, "bin").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), F.min("score").alias("score"))
    mixed = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    apart = parts.join(bins.filter(mixed).select(*by, "bin"), [*by, "bin"], "left_semi")
    apart = apart.groupBy(*by, "score").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    return _auroc_of_ties(bins.filter(~mixed).select(*by, "score", "_pos", "_neg").unionByName(apart), by, "score")


# metric name -> expression over the confusion counts
SCORERS: dict[str, Callable[[], Column]] = {
    "MCC": mcc,
    "F1": f1,
    "Fb05": lambda: fbeta(0.5),
    "Fb01": lambda: fbeta(0.1),
    "ACC": accuracy,
    "SN": sensitivity,
    "SP": specificity,
    "accuracy": accuracy,
    "sensitivity": sensitivity,
    "specificity": specificity,
}
REPORT = ["MCC", "F1", "Fb05", "Fb01", "ACC", "SN", "SP"]
ALL_METRICS = ["AUROC", *REPORT]


def score_by(name: str) -> Callable[[], Column]:
    if name not in SCORERS:
        raise ValueError(f"unknown metric {name}; expected one of {sorted(SCORERS)} or AUROC")
    return SCORERS[name]


def metric_report(
    df: DataFrame, by: Sequence[str], label: str, score: str, threshold: float = 0.5
) -> DataFrame:
    """AUROC and all threshold metrics per group, one row each."""
    rows = df.withColumn("_predicted", threshold_label(score, threshold))
    counts = confusion(rows, by, label, "_predicted")
    values = counts.select(*by, *[SCORERS[m]().alias(m) for m in REPORT])
    ranks = auroc(df, by, label, score)
    return values.join(ranks, list(by)) if by else values.crossJoin(ranks)


def evaluate(df: DataFrame, label: str, score: str, metric, threshold: float = 0.5) -> DataFrame:
    """One metric by name, or by a callable from (df, label, score) to a one-row frame."""
    if callable(metric):
        return metric(df, label, score)
    return evaluate_all(df, label, score, [metric], threshold)


def evaluate_all(
    df: DataFrame, label: str, score: str, names: Sequence[str] = tuple(ALL_METRICS), threshold: float = 0.5
) -> DataFrame:
    """(metric, value) for any number of names, from one count of the rows and one ranking."""
    counts = confusion(df.withColumn("_predicted", threshold_label(score, threshold)), [], label, "_predicted")
    if "AUROC" in names:
        counts = counts.crossJoin(auroc(df, [], label, score))
    cells = [
        F.struct(F.lit(n).alias("metric"), (F.col("AUROC") if n == "AUROC" else score_by(n)()).alias("value")) for n in names
    ]
    return counts.select(F.inline(F.array(*cells)))


def r2(df: DataFrame, by: Sequence[str], actual: str, predicted: str, clip: bool = False) -> DataFrame:
    """1 - SSE/SST per group in one aggregation; the variance is kept stably, so nothing cancels."""
    err = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    out = df.groupBy(*by).agg(F.when(total > 0, 1 - F.sum(err * err) / total).alias("r2"))
    return out.withColumn("r2", F.greatest("r2", F.lit(0.0))) if clip else out


def fold_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over folds per dataset; ensemble and refit rows pass through.

    ``scores`` has (dataset, fold, metric...).
    """
    return scores.groupBy("dataset").agg(*[F.avg(m).alias(m) for m in metrics])


def model_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation per model, the best mean MCC first."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return scores.groupBy("model").agg(*aggs).orderBy(F.desc("MCC_mean"), "model")


def cv_mean_std(scores: DataFrame, metric: str) -> DataFrame:
    """Mean and sample deviation of one metric."""
    return scores.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def rank_models(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Models by the average of their metrics."""
    average = sum((F.col(f"{m}_mean") for m in metrics[1:]), F.col(f"{metrics[0]}_mean")) / len(metrics)
    return summary.select("model", average.alias("average")).orderBy(F.desc("average"), "model")


def ensemble_average(predictions: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean of the models' scores per row, over as many models as scored it."""
    return predictions.groupBy(*keys).agg(F.avg(score).alias(score), F.count("*").alias("models"))


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean and sample deviation per feature over folds, largest first."""
    return (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))
        .orderBy(F.desc("mean"), "feature")
    )


def importance_by_fold(importances: DataFrame, folds: Sequence[int]) -> DataFrame:
    """The folds' importances side by side."""
    wide = importances.groupBy("feature").pivot("fold", list(folds)).agg(F.first("importance"))
    return wide.select("feature", *[F.col(str(f)).alias(f"Fold{f + 1}") for f in folds])


def top_features(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(F.desc("mean"), "feature").limit(n)


def irrelevant_features(importances: DataFrame) -> DataFrame:
    """Features whose mean split count is exactly zero."""
    return importance_summary(importances).filter("mean = 0").select("feature")


def mean_abs_attribution(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and fold, then mean and deviation over folds."""
    per_fold = attributions.groupBy("fold", "feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return importance_summary(per_fold)


def best_row(df: DataFrame, name: str, score: str) -> DataFrame:
    """The name with the highest score; the first in order wins a tie."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("_b")
    return df.agg(best).select(F.col("_b.n").alias(name), (-F.col("_b.s")).alias(score))


def class_weight(df: DataFrame, label: str, positive: float = 0.1) -> DataFrame:
    """Weight column: ``positive`` for label 1, one for the rest."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(1.0)))


def class_balance(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n_rows"))
