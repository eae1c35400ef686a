"""Running a stream over the data that is there, and reading the result back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder of the cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="clipwarden-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Processes everything available, writes it to files and returns them as a table.

    With ``mode="update"`` every batch is written with its number, so that the
    caller can keep the newest version of a row.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/out").start()
    else:
        from pyspark.sql import functions as F

        def save(batch: DataFrame, number: int) -> None:
            # overwriting its own folder makes a repeated batch harmless
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part-{number}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out"), query
    return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out"), query
