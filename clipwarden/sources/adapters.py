"""Label formats of one's own, as a table function.

A format is a schema and a function from a document's text to rows.  The table
function gets the name of a format first; its ``analyze`` step gives the columns
of that format, so one function serves all of them, in SQL and from DataFrames.
Documents are parsed where they lie: each is a call, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class Format:
    """Columns as DDL, and what makes rows of a text; rows are tuples in that order."""

    schema: str
    parse: Callable[[str], Iterable[tuple]]


def register_formats(spark: SparkSession, formats: Mapping[str, Format], name: str = "parse_labels") -> None:
    """Makes ``name(format, text)`` known to the session; a null text has no rows."""
    schemas: dict[str, StructType] = {k: _parse_datatype_string(f.schema) for k, f in formats.items()}
    parsers = {k: f.parse for k, f in formats.items()}

    class ParseLabels:
        @staticmethod
        def analyze(form: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not form.isConstantExpression or form.value not in schemas:
                raise ValueError(f"the first argument names a format: one of {', '.join(sorted(schemas))}")
            return AnalyzeResult(schema=schemas[form.value])

        def eval(self, form: str, text: str):
            if text is not None:
                yield from parsers[form](text)

    spark.udtf.register(name, F.udtf(ParseLabels, useArrow=False))


def parsed(docs: DataFrame, form: str, keys: list[str], name: str = "parse_labels") -> DataFrame:
    """The keys of each document beside its rows; ``docs`` has the text as ``text``."""
    docs.select(*keys, "text").createOrReplaceTempView("_label_documents")
    kept = ", ".join(f"d.`{k}`" for k in keys)
    return docs.sparkSession.sql(f"SELECT {kept}, r.* FROM _label_documents d, LATERAL {name}('{form}', d.text) r")
