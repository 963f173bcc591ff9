"""Filling gaps and scaling features, learned on one table and applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.lookups import array_literal
from seqloom.operators.quantiles import exact_quantiles


def scaled_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the exact median, then subtract the mean and divide by the population deviation."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    medians = {r["name"]: r["mid"] for r in exact_quantiles(long, ["name"], "v", {"mid": 0.5}).collect()}
    filled = df.na.fill(medians)
    stats = filled.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def scaled(c: str) -> Column:
        sd = stats[f"{c}_s"] or 1.0
        return ((F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(sd)).alias(c)

    return filled.select(*[scaled(c) if c in columns else F.col(c) for c in filled.columns])


def fit_vector_scaler(train: DataFrame, vector: str):
    """A function that scales a feature array by what ``train`` holds: exact medians for the gaps,
    means and population deviations.  It keeps three numbers per feature."""
    long = train.select(F.posexplode(vector).alias("place", "v"))
    stats = long.groupBy("place").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).alias("gaps")
    ).orderBy("place").collect()
    middle = [0.0] * len(stats)
    if any(r["gaps"] for r in stats):
        for r in exact_quantiles(long, ["place"], "v", {"mid": 0.5}).collect():
            middle[r["place"]] = r["mid"]
        filled = long.withColumn("v", F.coalesce("v", F.get(array_literal(middle), F.col("place"))))
        stats = filled.groupBy("place").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("place").collect()
    means = array_literal([float(r["m"]) for r in stats])
    deviations = array_literal([float(r["s"]) or 1.0 for r in stats])
    medians = array_literal([float(v) for v in middle])

    def apply(column: Column | str) -> Column:
        return F.transform(
            column, lambda v, i: (F.coalesce(v, F.get(medians, i)) - F.get(means, i)) / F.get(deviations, i)
        )

    return apply
