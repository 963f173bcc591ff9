"""Assigning rows to cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordinal import hash_ordinals

# Default number of folds and seed.
NUM_FOLDS = 10
SEED = 42


def _digest(keys: Sequence[str], seed):
    salt = F.lit(f":{seed}") if isinstance(seed, int) else F.concat(F.lit(":"), seed.cast("string"))
    return F.md5(F.concat(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), salt))


def stratified_folds(
    df: DataFrame, keys: Sequence[str], label: str, num_folds: int = NUM_FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0..num_folds-1: rows of a class, in seeded hash order, are dealt out in turn."""
    shuffled = df.withColumn("_digest", _digest(keys, seed))
    dealt = hash_ordinals(shuffled, [label], "_digest", keys, name="_place")
    return dealt.withColumn("fold", ((F.col("_place") - 1) % num_folds).cast("int")).drop("_place", "_digest")


def repeated_folds(
    df: DataFrame, keys: Sequence[str], label: str, num_folds: int, num_repeats: int, seed: int = SEED
) -> DataFrame:
    """The same with ``repeat`` 0..num_repeats-1, each with its own seed."""
    repeats = F.explode(F.array(*[F.lit(r) for r in range(num_repeats)]))
    rows = df.withColumn("repeat", repeats)
    shuffled = rows.withColumn("_digest", _digest(keys, F.col("repeat") + F.lit(seed)))
    dealt = hash_ordinals(shuffled, ["repeat", label], "_digest", keys, name="_place")
    return dealt.withColumn("fold", ((F.col("_place") - 1) % num_folds).cast("int")).drop("_place", "_digest")


def leave_one_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row is a fold of its own, numbered in hash order."""
    shuffled = df.withColumn("_digest", _digest(keys, 0))
    placed = hash_ordinals(shuffled, [], "_digest", keys, name="_place")
    return placed.withColumn("fold", F.col("_place") - 1).drop("_place", "_digest")


def custom_folds(df: DataFrame, folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folds the caller names, joined on the key; rows without a fold keep null."""
    return df.join(folds.select(*keys, "fold"), list(keys), "left")


def fold_of_row(df: DataFrame) -> DataFrame:
    """The 1-based validation fold each row is reported under."""
    return df.withColumn("valid_fold", F.col("fold") + 1)


def create_folds(
    df: DataFrame, keys: Sequence[str], label: str, num_folds: int, num_repeats: int = 1, seed: int = SEED
) -> DataFrame:
    """Leave-one-out when ``num_folds`` is -1, repeated folds above one repeat, else plain folds."""
    if num_folds == -1:
        return leave_one_out(df, keys).withColumn("repeat", F.lit(0))
    if num_repeats > 1:
        return repeated_folds(df, keys, label, num_folds, num_repeats, seed)
    return stratified_folds(df, keys, label, num_folds, seed).withColumn("repeat", F.lit(0))
