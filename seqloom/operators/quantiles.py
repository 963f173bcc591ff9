"""Exact quantiles, histogram widths and skew-proof lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordinal import running_totals
from seqloom.session import cut

#: Groups whose row is sent to all tasks; of more, only those of crowded groups are.
GROUPS = 1 << 16


def beside(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the one row that a table has of their group; a group that holds most rows stays spread."""
    if not by:
        return rows.crossJoin(F.broadcast(table))
    table = cut(table)
    return rows.join(F.broadcast(table), list(by)) if table.count() <= GROUPS else skewed_lookup(rows, table, by)


def collapsed(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, _n): how many rows have each value that is known."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, without holding a group in one task.

    Equal values collapse, a running total says which ranks each value covers,
    and the two values around every wanted rank are picked out.
    """
    return _quantiles(collapsed(df, by, value), by, value, shares)


def _quantiles(ties: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    sizes = ties.groupBy(*by).agg(F.sum("_n").alias("n_rows"))
    placed = running_totals(ties, by, [value], {"_before": "_n"})
    rows = beside(placed, sizes, by)
    picks = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("n_rows") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            covered = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(covered, F.col(value))).alias(f"_{name}_{side}"))
    found = rows.groupBy(*by, "n_rows").agg(F.min(value).alias("low"), F.max(value).alias("high"), *picks)

    def between(name: str, share: float):
        rank = F.lit(share) * (F.col("n_rows") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (rank - F.floor(rank))).alias(name)

    return found.select(*by, "n_rows", "low", "high", *[between(n, s) for n, s in shares.items()])


def auto_bins(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Histogram layout per group: low, high and the larger of the two usual bin counts.

    Sturges needs log2(n) + 1 bins; Freedman and Diaconis ask for a width of
    2 IQR / n^(1/3), which counts only where the quartiles differ.
    """
    return _bins(collapsed(df, by, value), by, value)


def _bins(ties: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    q = _quantiles(ties, by, value, {"q1": 0.25, "q3": 0.75})
    span = F.col("high") - F.col("low")
    n = F.col("n_rows").cast("double")
    sturges = span / (F.log2(n) + 1)
    spread = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3))
    width = F.when(spread > 0, F.least(sturges, spread)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(span / width)).otherwise(F.lit(1)).cast("int")
    return q.select(*by, "n_rows", "low", "high", bins.alias("bins"))


def bin_of(value, low, high, bins):
    """0-based equal-width bin; the top edge belongs to the last bin."""
    place = F.floor((value - low) / (high - low) * bins).cast("int")
    return F.when(high > low, F.least(place, bins - 1)).otherwise(F.lit(0))


def histogram_entropy(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy of the automatic histogram, in nats.

    Equal values collapse once, for the layout and for the bins.
    """
    ties = cut(collapsed(df, by, value))
    rows = beside(ties, _bins(ties, by, value), by)
    placed = rows.withColumn("_bin", bin_of(F.col(value), F.col("low"), F.col("high"), F.col("bins")))
    counts = placed.groupBy(*by, "bins", "n_rows", "_bin").agg(F.sum("_n").alias("_n"))
    p = F.col("_n") / F.col("n_rows")
    return counts.groupBy(*by, "bins").agg((-F.sum(p * F.log(p))).alias("entropy"))


def skewed_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], share: float = 0.001) -> DataFrame:
    """Join rows to a table that has one row per key, when single keys may hold a large part of the rows.

    Keys that hold more than ``share`` of the rows number at most 1/share, so their
    table rows are broadcast; all other keys go through an ordinary join.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = counts.filter(F.col("_n") > max(100_000, int(total * share))).select(*keys)
    if not heavy.head(1):
        return rows.join(table, list(keys))
    hot = F.broadcast(table.join(F.broadcast(heavy), list(keys), "left_semi"))
    by_broadcast = rows.join(hot, list(keys))
    by_shuffle = rows.join(F.broadcast(heavy), list(keys), "left_anti").join(table, list(keys))
    return by_broadcast.unionByName(by_shuffle)
