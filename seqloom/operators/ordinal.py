"""Ranks, ordinals and running totals that no single task has to compute.

A window over a whole class, score or table would put all its rows in one task.
Here the rows are range-partitioned by (group, order) instead, so a group of any
size spreads over many partitions; each partition sums locally, the partition
totals (at most one row per group and partition) are accumulated, and every row
adds its local running sum to what came before its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import cut


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column | str]
) -> DataFrame:
    """Add, for each entry of ``sums``, its total over the rows that come earlier in the group.

    (by, order) must identify a row.  Range bounds are sampled, so the partitioned rows
    are cut to the checkpoint folder with their partition number before they are
    used twice: a lost executor cannot shift a row to another partition.
    """
    keys = [*by, *order]
    measured = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_m_{n}") for n, c in sums.items()])
    parted = cut(measured.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy(*by, "_part").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = parted.join(offsets, [*by, "_part"])
    return placed.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_m_{n}").over(local), F.lit(0))).alias(n) for n in sums],
    )


def row_ordinals(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1-based position of each row within its group."""
    return running_totals(df, by, order, {"_before": F.lit(1)}).withColumn(
        name, F.col("_before") + 1
    ).drop("_before")


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: how many rows have it, and their shared average rank.

    Ties collapse before anything is ordered, so a value that a third of all rows
    share is one row here.
    """
    ties = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running_totals(ties, by, [value], {"_before": "ties"}).select(
        *by, value, "ties", (F.col("_before") + (F.col("ties") + 1) / 2).alias("avg_rank")
    )


def hash_ordinals(
    df: DataFrame, by: Sequence[str], digest: str, ties: Sequence[str], buckets: int = 4096, name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row within its group in the order of a hex digest.

    The digest's leading digits are uniform, so they cut every group into even
    buckets; a bucket is what one task orders.  ``buckets`` is a power of 16.
    """
    digits = len(f"{buckets - 1:x}")
    rows = df.withColumn("_bucket", F.substring(digest, 1, digits))
    totals = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_bucket")
    before = before.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = W.partitionBy(*by, "_bucket").orderBy(digest, *ties)
    return (
        rows.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(local))
        .drop("_bucket", "_offset")
    )
