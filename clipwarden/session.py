"""Session helpers: where long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: has Spark drop the shuffle files of a query at its end, not when the driver happens to collect its garbage
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; only where it is unset, as in local tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="clipwarden-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder of the cluster."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that stores large tables for the length of the block.

    It cuts the lineage like ``checkpoint``, but writes Parquet files, leaves no
    shuffle files, and all of its tables are removed at the end of the block.
    """
    top = f"{_shared_folder(spark).rstrip('/')}/clipwarden-{uuid.uuid4().hex}"

    def store(df: DataFrame) -> DataFrame:
        path, before = f"{top}/{uuid.uuid4().hex}", spark.conf.get(_CLEAN, "false")
        spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEAN, before)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield store
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
