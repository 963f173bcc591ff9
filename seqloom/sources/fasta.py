"""FASTA records in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "\n>"


def read_sequences(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(ID, Sequence)`` and where each record stood: ``file``, ``block``, ``row``.

    The text source splits files on the record mark, so a record is never cut in
    two and large files are read by many tasks.  ``row`` rises with the position
    inside one split, which together with file and split offset orders the records.
    A record without an ID has a null one and keeps its place; white space before the first record is none.
    """
    raw = spark.read.option("lineSep", RECORD).text(paths if isinstance(paths, str) else list(paths))
    raw = raw.select(
        F.regexp_replace("value", "\r", "").alias("record"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    record = F.regexp_replace("record", "^\\s*>", "")
    header = F.regexp_extract(record, "^[^\n]*", 0)
    body = F.regexp_replace(record, "^[^\n]*", "")
    return raw.select(
        F.nullif(F.regexp_extract(header, "^\\s*(\\S+)", 1), F.lit("")).alias("ID"),
        F.regexp_replace(body, "\\s", "").alias("Sequence"),
        "file",
        "block",
        "row",
    ).filter("ID IS NOT NULL OR Sequence <> ''")


def read_label_rows(spark: SparkSession, paths: str | Sequence[str], column: str = "CPP") -> DataFrame:
    """Label lines with the same place columns, so that they can be lined up with records.

    The header line, which is the column's name, and blank lines are no labels; a line that is neither 0 nor 1 is a
    null label and keeps its place.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.trim("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    label = F.when(F.col("value").rlike("^[01]$"), F.col("value")).cast("int")
    header = F.lower(F.regexp_replace("value", '"', "")) == column.lower()
    return raw.filter((F.col("value") != "") & ~header).select(label.alias(column), "file", "block", "row")


def write_sequences(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One two-line record per row."""
    df.select(F.concat(F.lit(">"), F.col("ID"), F.lit("\n"), F.col("Sequence")).alias("value")).write.mode(
        mode
    ).text(path)
