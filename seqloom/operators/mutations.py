"""What changed between an original string and its edited form, and search-log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions import lookups as L
from seqloom.functions.sequences import letters


def zip_positions(df: DataFrame, keys: Sequence[str], original: str, edited: str) -> DataFrame:
    """One row per position of the shorter string: keys, pos, o, m."""
    n = F.least(F.length(original), F.length(edited))
    rows = df.select(*keys, letters(original).alias("_o"), letters(edited).alias("_m"), n.alias("_n")).filter("_n > 0")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(*keys, "pos", F.element_at("_o", F.col("pos")).alias("o"), F.element_at("_m", F.col("pos")).alias("m"))


def mutation_cells(df: DataFrame, original: str, edited: str) -> DataFrame:
    """How often each letter was replaced by each other one."""
    changed = zip_positions(df, [], original, edited).filter("o <> m")
    return changed.groupBy("o", "m").agg(F.count("*").alias("n"))


def mutation_matrix(df: DataFrame, original: str, edited: str) -> DataFrame:
    """The cells as a matrix: one row per original letter, one column per new letter."""
    cells = mutation_cells(df, original, edited)
    return cells.groupBy("o").pivot("m", list(L.LETTERS)).agg(F.sum("n")).na.fill(0)


def mutation_share(cells: DataFrame) -> DataFrame:
    """Percent of all replacements per cell, and row and column sums of the rounded percents.

    At most 400 cells reach the window, whatever the size of the log.
    """
    everything = W.partitionBy(F.lit(0))
    share = F.round(100 * F.col("n") / F.sum("n").over(everything), 2)
    rows = cells.select("o", "m", share.alias("share"))
    return rows.select(
        "o",
        "m",
        "share",
        F.sum("share").over(W.partitionBy("o")).alias("row_total"),
        F.sum("share").over(W.partitionBy("m")).alias("column_total"),
    )


def drop_incomplete(log: DataFrame) -> DataFrame:
    return log.na.drop()


def at_generation(log: DataFrame, generation: int) -> DataFrame:
    """The log at one generation; targets that stopped earlier are not in it."""
    return log.filter(F.col("generation") == generation)


def last_generation(log: DataFrame, target: str = "target_id") -> DataFrame:
    """Each target's last logged row, including those that stopped early."""
    # a window, so that the log is made once
    last = F.max("generation").over(W.partitionBy(target))
    rows = log.filter(F.col(target).isNotNull()).withColumn("_last", last)
    return rows.filter(F.col("generation") == F.col("_last")).drop("_last")
