"""What the operators of this subpackage share: tables, stored interim results, Arrow batches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import checkpoint_folder, cut, spread_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL it must agree with."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


#: Rows of a batch that goes to or comes from Python, where the session has Spark's default of BATCH[0].
BATCH = "10000", "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long rows: a default batch of them is tens of megabytes in each task, twice in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == BATCH[0]:
        spark.conf.set(name, BATCH[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, other columns to keep) spread over the cores; a null text is the empty text."""
    bounded_batches(df.sparkSession)
    return spread_rows(df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text), *[c for c in keep if c != text]))


def fields(df: DataFrame, *names: str) -> str:
    """The columns as the beginning of a schema string."""
    return "".join(f"{n} {df.schema[n].dataType.simpleString()}, " for n in names)


def with_size_check(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """Join with a table that goes to all tasks if it has at most ``most`` rows, and is shuffled if it has more."""
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    return left.hint("merge").join(right, on, how)


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder; Spark's cleaner removes it when it is no longer used."""
    return cut(df)


class Scratch:
    """Tables written to a folder of their own in the shared checkpoint folder.

    For iterations: a checkpoint keeps the optimizer's estimate of its size, which joins multiply in every round
    until the numbers themselves are too long to handle; a written table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid.uuid4()}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]  # keeps the ids apart
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for one in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(one)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks whose vectors are added up in one group, before the groups are.
ADDED = 64


def sum_vectors(parts: DataFrame, dtype) -> np.ndarray | None:
    """The sum of vectors that tasks have cut into compressed parts (part int, vector binary); None without any."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(v), dtype) for v in group.vector)
        return pd.DataFrame({"part": [int(group.part.iloc[0])], "vector": [zlib.compress(total.tobytes(), 1)]})

    turn = F.spark_partition_id() % ADDED
    some = parts.select("part", "vector", turn.alias("turn")).groupBy("part", "turn").applyInPandas(add, "part int, vector binary")
    every = some.groupBy("part").applyInPandas(add, "part int, vector binary").collect()  # one vector
    return np.concatenate([np.frombuffer(zlib.decompress(v), dtype) for _, v in sorted(every)]) if every else None


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only those become Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def grouped(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int) -> Iterator[tuple[pa.Array, list]]:
    """Keys and texts; a group ends when its texts reach ``limit`` characters."""
    keys, group, size = [], [], 0
    for batch in small(batches):
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
            keys.append(k)
            group.append(t)
            size += len(t)
            if size >= limit:
                yield pa.array(keys, batch.schema.field(key).type), group
                keys, group, size = [], [], 0
    if keys:
        yield pa.array(keys, batch.schema.field(key).type), group
