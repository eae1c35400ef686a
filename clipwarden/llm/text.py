"""Column expressions and helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: everything that is neither a digit, an ASCII letter nor beyond ASCII
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1
#: has Spark drop the shuffle files of a query at its end, not when the driver happens to collect its garbage
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[str | None] = ContextVar("passing", default=None)  # folder of tables that ``settled`` removes


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def letter_words(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters beyond ASCII, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def ascii_lower(word: Column) -> Column:
    """A-Z to a-z and nothing else; words of ASCII alone take the fast function."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id``, ``rk`` and ``text``.

    A null id counts as the largest; ``(id, rk)`` tells rows apart unless they
    agree in id and text, and such rows get the same results anyway.
    """
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    return docs.select(number.alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.coalesce(F.col(text_col), F.lit("")))


def plain_id(column: str = "id") -> Column:
    """Takes back what ``keyed`` did to null ids."""
    return F.when(F.col(column) != LAST_ID, F.col(column))


def unused(columns: list[str], base: str) -> str:
    """A column name that does not clash with any of ``columns``."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; inside ``settled`` one that goes with it."""
    sc = spark.sparkContext
    top = _passing.get() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        top = tempfile.mkdtemp(prefix="clipwarden-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/clipwarden-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends there, and sizes are known."""
    return stored_at(df, shared_folder(df.sparkSession))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``stored`` in a given folder."""
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Writes Parquet files and leaves no shuffle files: nothing else reads those of a write."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_folder`` gave, or one inside it."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, stored; the tables that ``build`` stores on its way are removed then.

    What ``build`` returns may read them, nothing else may.
    """
    path, passing = shared_folder(spark), shared_folder(spark)
    outer = _passing.set(passing)
    try:
        return stored_at(build(), path)
    finally:
        _passing.reset(outer)
        remove(spark, passing)


def written_place(df: DataFrame, name: str) -> DataFrame:
    """Adds where each row of a written table stands: number and name of its file, then its row there.

    Spark numbers the files by partition, so a range-sorted table has its order
    back.  The table has to come straight from Parquet files.
    """
    file = F.col("_metadata.file_name")
    number = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")
    return df.withColumn(name, F.struct(number.alias("number"), file.alias("file"), F.col("_metadata.row_index").alias("row")))
