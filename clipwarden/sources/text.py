"""Whole documents as rows: reading them and taking XML leaves out of text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import file_stem
from .raw_folders import local_path


def _texts_below(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            for first in range(0, len(names), 1000):
                paths = [f"{root}/{name}" for name in names[first : first + 1000]]
                texts = []
                for path in paths:
                    with open(path, encoding="utf-8", newline="") as file:
                        texts.append(file.read())
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.string())})

    return read


def read_documents(spark: SparkSession, path: str, glob: str = "*", listed: DataFrame | None = None) -> DataFrame:
    """One row per file: ``path, clip (file stem), text``.  Files are split over tasks.

    Spark lists the files at the driver, which holds a few hundred bytes of each.
    Where a table knows them, ``listed`` (``path`` below the folder, each once)
    is read instead: its tasks open the files, which needs a mounted file system.
    An empty file is a row then, which Spark's reader leaves out.
    """
    if listed is not None:
        found = listed.select("path").mapInArrow(_texts_below(local_path(path).rstrip("/")), "path string, text string")
        return found.select("path", file_stem(F.col("path")).alias("clip"), "text")
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        file_stem(F.col("_metadata.file_path")).alias("clip"),
        F.col("value").alias("text"),
    )


def read_paths(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File listing only: the content column is pruned, so no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def leaf(text: Column, tag: str) -> Column:
    """Trimmed text of the first element called ``tag`` at any depth, NULL when absent.

    Annotation files differ in nesting and are sometimes cut off; a pattern
    reads what is there where a strict parser would lose the whole file.
    """
    tag = re.escape(tag)
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?>\s*([^<]*?)\s*</{tag}>"
    found = F.regexp_extract(text, pattern, 1)
    for entity, char in _ENTITIES:
        found = F.replace(found, F.lit(entity), F.lit(char))
    return F.when(text.rlike(pattern), found)


def elements(text: Column, tag: str) -> Column:
    """Inner text of every element called ``tag``, in document order."""
    tag = re.escape(tag)
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
