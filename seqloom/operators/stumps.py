"""One boosting step as a query: the best (feature, bin) by histogram gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.quantiles import bin_of


def split_gains(
    df: DataFrame, vector: str, label: str, bins: int = 255, min_rows: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """(feature, bin, gain): gain of sending bins 0..bin left, for every split with enough rows on both sides.

    The histogram has at most features x bins rows whatever the table holds, and only
    that histogram is ordered.
    """
    rows = df.select(*by, F.col(label).cast("double").alias("_y"), F.posexplode(vector).alias("feature", "value"))
    ends = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    p0 = df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_p0"))
    placed = rows.join(F.broadcast(ends), "feature").select(
        *by, "feature", "_y", bin_of(F.col("value"), F.col("low"), F.col("high"), F.lit(bins)).alias("bin")
    )
    counts = placed.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
    cells = counts.join(p0, list(by)) if by else counts.crossJoin(F.broadcast(p0))
    cells = cells.withColumn("g", F.col("n") * F.col("_p0") - F.col("pos")).withColumn(
        "h", F.col("n") * F.col("_p0") * (1 - F.col("_p0"))
    )
    left = W.partitionBy(*by, "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by, "feature")
    c = F.col
    for name in ("n", "g", "h"):
        cells = cells.withColumn(f"l_{name}", F.sum(name).over(left)).withColumn(f"t_{name}", F.sum(name).over(whole))
    gain = (
        c("l_g") * c("l_g") / c("l_h")
        + (c("t_g") - c("l_g")) * (c("t_g") - c("l_g")) / (c("t_h") - c("l_h"))
        - c("t_g") * c("t_g") / c("t_h")
    )
    enough = (c("l_n") >= min_rows) & (c("t_n") - c("l_n") >= min_rows)
    return cells.filter(enough).select(*by, "feature", "bin", gain.alias("gain"))


def best_split(gains: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The split with the largest gain; feature and bin settle ties."""
    best = F.min(F.struct((-F.round("gain", 9)).alias("g"), "feature", "bin")).alias("_b")
    return gains.groupBy(*by).agg(best).select(
        *by, F.col("_b.feature").alias("feature"), F.col("_b.bin").alias("bin"), (-F.col("_b.g")).alias("gain")
    )
