"""Reading and writing plain tables: labels, lookup matrices, pairs, blocks, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_labels(spark: SparkSession, paths: str | Sequence[str], column: str = "CPP") -> DataFrame:
    """A one-column label file with a header line."""
    return spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True, schema=f"{column} int")


def read_pairs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of (Original, Edited) pairs, one below the other."""
    return spark.read.csv(list(paths), header=True, schema="Original string, Optimized string")


def read_lookup(spark: SparkSession, path: str, letters: str, key: str = "prop") -> DataFrame:
    """A tab-separated matrix whose header names the letters -> (key, letter, value).

    ``letters`` is the header's order.  Stray carriage returns are dropped.
    """
    schema = f"{key} string, " + ", ".join(f"`{a}` string" for a in letters)
    wide = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)
    long = wide.unpivot([key], list(letters), "letter", "value")
    return long.select(key, "letter", F.regexp_replace("value", "\\s", "").cast("double").alias("value"))


def lookup_rows(df: DataFrame, key: str = "prop") -> dict[str, dict[str, float]]:
    """A lookup as ``{property: {letter: value}}`` for the descriptors; one row per letter and property."""
    rows: dict[str, dict[str, float]] = {}
    for r in df.select(key, "letter", "value").collect():
        rows.setdefault(r[0], {})[r[1]] = r[2]
    return rows


def lookup_pairs(df: DataFrame, key: str = "prop") -> dict[tuple[str, str], float]:
    """A letter-by-letter matrix as ``{(row, column): value}``: at most one entry per letter pair."""
    return {(a, b): v for a, row in lookup_rows(df, key).items() for b, v in row.items()}


def write_lookup(df: DataFrame, path: str, letters: str, key: str = "prop") -> None:
    """The inverse of `read_lookup`: (key, letter, value) to a tab-separated matrix."""
    wide = df.groupBy(key).pivot("letter", list(letters)).agg(F.first("value"))
    wide.write.mode("overwrite").csv(path, sep="\t", header=True)


def block_name(descriptor: str) -> str:
    """Blocks are named by the descriptor up to its first space."""
    return descriptor.split(" ")[0]


def write_block(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long feature rows with a ``block`` column, one partition folder per block."""
    blocks.write.mode(mode).partitionBy("block").parquet(path)


def read_block(spark: SparkSession, path: str, *descriptors: str) -> DataFrame:
    """The named blocks only; the filter prunes partition folders."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("block").isin([block_name(d) for d in descriptors])) if descriptors else rows


def write_results(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """Search logs, attributions and search results, partitioned by run."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)
