"""Splits, unions, joins and set operations between sequence and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.ordinal import row_ordinals


def tag_split(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("Dataset", F.lit(name))


def select_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("Dataset") == name)


def select_negatives(df: DataFrame, label: str, *columns: str) -> DataFrame:
    return df.filter(F.col(label) == 0).select(*columns)


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def positional_join(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Line up two tables by row number (for files: by file, split offset, row).

    Tables of different lengths cannot be lined up and are an error.
    """
    lengths = left.count(), right.count()
    if lengths[0] != lengths[1]:
        raise ValueError(f"cannot line up {lengths[0]} rows with {lengths[1]}")
    a = row_ordinals(left, [], left_order, "_ordinal").drop(*(set(left_order) & {"file", "block", "row"}))
    b = row_ordinals(right, [], right_order, "_ordinal").drop(*(set(right_order) & {"file", "block", "row"}))
    return a.join(b, "_ordinal").drop("_ordinal")


def create_combined(spark: SparkSession, train_fasta, train_labels, test_fasta, test_labels) -> DataFrame:
    """Sequences and labels of both splits as one table (ID, Sequence, CPP, Dataset)."""
    from seqloom.sources.fasta import read_label_rows, read_sequences

    place = ["file", "block", "row"]
    parts = [
        tag_split(
            positional_join(read_sequences(spark, fasta), read_label_rows(spark, labels), place, place).select(
                "ID", "Sequence", "CPP"
            ),
            name,
        )
        for fasta, labels, name in ((train_fasta, train_labels, "train"), (test_fasta, test_labels, "test"))
    ]
    return union_splits(*parts)


def join_descriptor(base: DataFrame, block: DataFrame) -> DataFrame:
    """A block onto the base by the composite key, as an ID may occur in both splits."""
    return base.join(block, ["ID", "Dataset"])


def join_blocks(blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Long blocks (keys, feature, value) folded into one map per key: a single shuffle for any number."""
    rows = blocks[0]
    for other in blocks[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features")
    )


def dense_features(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """The maps as arrays in a fixed order, zero where a sparse block has no cell."""
    cells = [F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)) for n in names]
    return joined.withColumn("features", F.array(*cells))


def feature_index(dictionary: DataFrame) -> DataFrame:
    """(feature, place): the names in sorted order, counted from zero."""
    names = dictionary.select("feature").distinct()
    return row_ordinals(names, [], ["feature"], "_o").select("feature", (F.col("_o") - 1).cast("int").alias("place"))


def dense_vectors(blocks: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, features): sparse long rows as full arrays in the order of ``index``, zeros filled in.

    The cells of a key are sorted by place and the gaps between them filled, so the work per key
    grows with the array's length.  The index has one small row per feature name.
    """
    size = index.count()
    placed = blocks.join(index, "feature").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value")))).alias("_cells")
    )
    ends = F.struct(F.lit(size).alias("place"), F.lit(0.0).alias("value"))
    starts = F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("value"))
    placed = placed.select(
        *keys, F.concat(F.array(starts), "_cells").alias("_from"), F.concat("_cells", F.array(ends)).alias("_to")
    )

    def gap_and_cell(a, b):
        zeros = F.array_repeat(F.lit(0.0), b["place"] - a["place"] - 1)
        return F.when(b["place"] == size, zeros).otherwise(F.concat(zeros, F.array(b["value"])))

    return placed.select(*keys, F.flatten(F.zip_with("_from", "_to", gap_and_cell)).alias("features"))


def feature_dictionary(blocks: DataFrame) -> DataFrame:
    """Which features each block has."""
    return blocks.select("block", "feature").distinct()


def sorted_names(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("feature").distinct().orderBy("feature")


def select_features(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Long rows whose feature is named."""
    return blocks.join(names.select("feature"), "feature", "left_semi")


def feature_difference(names: DataFrame, dropped: DataFrame) -> DataFrame:
    return names.select("feature").join(dropped.select("feature"), "feature", "left_anti")


def count_features(names: DataFrame) -> DataFrame:
    return names.agg(F.countDistinct("feature").alias("n_features"))


def leakage(a: DataFrame, b: DataFrame, column: str = "Sequence") -> DataFrame:
    """Rows of ``a`` with ``shared``: whether the sequence also occurs in ``b``.  A null sequence is shared with none.

    Digests of 256 bits meet instead of the sequences, those of ``b`` once each; a digest that many rows of ``a``
    have is split by the adaptive join.
    """
    digest = F.sha2(F.col(column).cast("binary"), 256)
    other = b.select(digest.alias("_digest")).filter("_digest IS NOT NULL").distinct().withColumn("shared", F.lit(True))
    met = a.withColumn("_digest", digest).join(other, "_digest", "left")
    return met.withColumn("shared", F.coalesce("shared", F.lit(False))).drop("_digest")


def shared_sequences(a: DataFrame, b: DataFrame, column: str = "Sequence") -> DataFrame:
    """Rows of ``a`` whose sequence also occurs in ``b``: leakage between splits."""
    return leakage(a, b, column).filter("shared").drop("shared")


def unshared_sequences(a: DataFrame, b: DataFrame, column: str = "Sequence") -> DataFrame:
    return leakage(a, b, column).filter("NOT shared").drop("shared")


def pairs_to_labeled(pairs: DataFrame, order: Sequence[str], original: str, edited: str) -> DataFrame:
    """Each pair as two labeled rows, ``Negative_i`` for the original and ``Positive_i`` for the edited one."""
    numbered = row_ordinals(pairs, [], order, "_i")
    i = F.col("_i").cast("string")
    both = F.inline(
        F.array(
            F.struct(
                F.concat(F.lit("Negative_"), i).alias("ID"), F.col(original).alias("Sequence"),
                F.lit(0).alias("CPP"), F.lit("Original_nonCPP").alias("Dataset"),
            ),
            F.struct(
                F.concat(F.lit("Positive_"), i).alias("ID"), F.col(edited).alias("Sequence"),
                F.lit(1).alias("CPP"), F.lit("Optimized_CPP").alias("Dataset"),
            ),
        )
    )
    return numbered.select(both)


def product_grid(targets: DataFrame, generations: int) -> DataFrame:
    """Every target with every generation number."""
    return targets.withColumn("generation", F.explode(F.sequence(F.lit(1), F.lit(generations))))
