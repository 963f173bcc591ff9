"""Session helpers: where lineage is cut, and how work is spread over cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "seqloom", cores: str = "8") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and interim tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` has made and that nothing will read again."""
    for df in tables:
        found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if found.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Give a table that arrives in a few splits to all cores.

    A large table already has more splits than cores and is returned as it is,
    so no exchange is added there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *columns) if columns else df.repartition(want)


def spread_keys(df: DataFrame, key: str, at_once: int) -> DataFrame:
    """Deal a table of short rows by its key, in order, ``at_once`` rows to a task on average.

    For rows that become many: what follows per key needs no other exchange, and a task's share
    does not grow with the table.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // at_once))
    return df.repartition(tasks, key).sortWithinPartitions(key)
