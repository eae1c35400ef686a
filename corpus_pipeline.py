"""Training-corpus pipeline: grade, deduplicate, decontaminate, mix, write tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipwarden.llm import curriculum, decontaminate, quality, similarity, token_files
from clipwarden.llm.queries import table, tokenizer_file
from clipwarden.llm.text import LAST_ID, row_key, settled, unused, written_place


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier grades as good; it learns from the labelled documents of the input."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, similarity of at least 0.8.

    SimHash fingerprints and MinHash bands give candidates, whole shingle sets decide.
    """
    return similarity.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth occurs in the benchmark."""
    found = decontaminate.contamination_report(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_cw_id"), F.col("rk").alias("_cw_rk")
    ).distinct()
    tagged = docs.withColumns({"_cw_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "_cw_rk": row_key("doc_id", "text")})
    return tagged.join(found, ["_cw_id", "_cw_rk"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, as often as the mix takes them."""
    return curriculum.mixed_documents(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in training order, and per document its place, length and checksum in them.

    The order is the one in which the mix was written; ``docs`` is read from those files.
    """
    place = unused(docs.columns, "_cw_place")
    return token_files.token_file_digest(written_place(docs, place), tokenizer_file(), order_col=place)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("source_mixing", mixed),
    ("token_output", token_rows),
]

# A fitted classifier, fingerprints and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage wrote goes when the next is written."""

    def after(stages: list) -> DataFrame:
        if not stages:
            return table(spark, sf_dir, "documents")
        return settled(spark, lambda: stages[-1][1](spark, after(stages[:-1]), sf_dir))

    return STAGES[-1][1](spark, after(STAGES[:-1]), sf_dir)
