"""Session settings and lineage cutting."""
from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, submit with the
    cluster's own settings instead: nothing in the operators depends on this."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("panelspark")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame, *keys: str, at_least: int = 1) -> DataFrame:
    """The rows dealt by keys over all shuffle partitions of the session, or more of them if asked for.

    Adaptive execution packs shuffles into tasks of 64 MB; narrow rows take some fifteen times as much in a hash table or
    a sort. A stated number of partitions is kept.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), at_least), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` (or a directory set on the context) wins. Only a
    local master may fall back to a temporary folder: on a cluster, executors
    could not read each other's local disks after a loss.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="panelspark-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the checkpoint folder, deleted with the ``intermediate_tables`` block around the call."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/panelspark-{uuid.uuid4().hex}"
    for block in _BLOCKS:
        block.append(path)
    return path


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """The same rows, read back from a table written to the checkpoint folder.

    Later steps scan only the columns they need, with real sizes to plan by, and
    an executor lost meanwhile costs no recomputation. The table lives until the folder
    is emptied, or until the ``intermediate_tables`` block around the call ends.
    options are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BLOCKS: list[list[str]] = []


@contextlib.contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``cut_lineage`` writes inside the block when it ends.

    Results must be used up inside: a DataFrame that reads such a table is dead afterwards.
    """
    made: list[str] = []
    _BLOCKS.append(made)
    try:
        yield
    finally:
        # By identity: two blocks may list the same tables, or none.
        _BLOCKS[:] = [block for block in _BLOCKS if block is not made]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in made:
            path = hadoop.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
