"""The composition descriptors for sequences that arrive as rows, one symbol each.

An event log folded per user is such a sequence.  A user may own a third of all
events, so the log is never gathered into one string: symbols are numbered by range
partitioning, and neighbours meet by a join on (group, position), which is even whatever
the group sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordinal import row_ordinals, running_totals
from seqloom.session import cut


def numbered_symbols(df: DataFrame, group: str, order: Sequence[str], symbol: str) -> DataFrame:
    """(group, pos, symbol) with pos 1, 2, ... in the given order; written once, as joins read it several times."""
    rows = row_ordinals(df.select(group, *order, F.col(symbol).alias("symbol")), [group], order, "pos")
    return cut(rows.select(group, F.col("pos").cast("long").alias("pos"), "symbol"))


def symbol_frequency(df: DataFrame, group: str, symbol: str) -> DataFrame:
    """Share of each symbol per group; needs no order."""
    counts = df.groupBy(group, F.col(symbol).alias("token")).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_size"))
    return counts.join(sizes, group).select(group, "token", (F.col("_n") / F.col("_size")).alias("value"))


def symbol_tokens(numbered: DataFrame, group: str, k: int, gap: int = 0) -> DataFrame:
    """(group, token) for every run of ``k`` symbols that stand ``gap`` apart."""
    rows = numbered.select(group, "pos", F.col("symbol").alias("token"))
    for j in range(1, k):
        later = numbered.select(
            group, (F.col("pos") - j * (gap + 1)).alias("pos"), F.col("symbol").alias("_next")
        ).filter("pos > 0")
        rows = rows.join(later, [group, "pos"]).select(group, "pos", F.concat("token", "_next").alias("token"))
    return rows.select(group, "token")


def symbol_kmer_frequency(numbered: DataFrame, group: str, k: int, gap: int = 0) -> DataFrame:
    """Share of each token among all tokens of the group."""
    return symbol_frequency(symbol_tokens(numbered, group, k, gap), group, "token")


def symbol_gapped_pairs(numbered: DataFrame, group: str, kspace: int) -> DataFrame:
    """As above for pairs at every gap 0..kspace."""
    out = None
    for gap in range(kspace + 1):
        part = symbol_kmer_frequency(numbered, group, 2, gap).withColumn("gap", F.lit(gap))
        out = part if out is None else out.unionByName(part)
    return out


def symbol_transitions(numbered: DataFrame, group: str) -> DataFrame:
    """Share of neighbours that differ, per unordered pair of symbols."""
    pairs = numbered.select(group, "pos", F.col("symbol").alias("_a")).join(
        numbered.select(group, (F.col("pos") - 1).alias("pos"), F.col("symbol").alias("_b")), [group, "pos"]
    )
    counts = pairs.groupBy(group, F.least("_a", "_b").alias("_x"), F.greatest("_a", "_b").alias("_y")).agg(
        F.count("*").alias("_n")
    )
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_size"))
    return (
        counts.filter("_x <> _y")
        .join(sizes, group)
        .select(group, F.concat("_x", "_y").alias("token"), (F.col("_n") / F.col("_size")).alias("value"))
    )


def symbol_ordered_pairs(
    df: DataFrame, group: str, order: Sequence[str], symbol: str, alphabet: Sequence[str]
) -> DataFrame:
    """Share of position pairs i < j per ordered pair of symbols, from running counts of each symbol."""
    rows = df.select(group, *order, F.col(symbol).alias("symbol"))
    counts = {f"_{i}": F.when(F.col("symbol") == a, 1).otherwise(0) for i, a in enumerate(alphabet)}
    before = running_totals(rows, [group], order, counts)
    per_second = before.groupBy(group, "symbol").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in counts])
    sizes = per_second.groupBy(group).agg(F.sum("_n").cast("double").alias("_size"))
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.col(f"_{i}").alias("n")) for i, a in enumerate(alphabet)]))
    size = F.col("_size")
    return (
        per_second.select(group, "symbol", cells)
        .filter("n > 0")
        .join(sizes, group)
        .select(group, F.concat("first", "symbol").alias("token"), (F.col("n") / (size * (size - 1) / 2)).alias("value"))
    )
