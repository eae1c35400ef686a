"""Token files follow the training order of the mix, and rows keep their columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipwarden.llm import curriculum
from clipwarden.llm.text import row_key, stored


def test_starts_rise_with_training_positions(spark):
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i % 7)), "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    due = curriculum.mix(docs).select("doc_id", F.explode("positions").alias("t")).collect()
    want = [r["doc_id"] for r in sorted(due, key=lambda r: (r["t"], r["doc_id"]))]
    mixed = stored(corpus_pipeline.mixed(spark, docs, ""))
    got = [r["doc_id"] for r in corpus_pipeline.token_rows(spark, mixed, "").orderBy("start").collect()]
    assert len(got) > len(set(got)) > 100 and got != sorted(got)
    assert got == want


def test_rows_of_one_id_and_text_keep_their_columns(spark):
    rows = [(1, "one two three", "a", "x"), (1, "one two three", "b", "y"), (1, "one two three", "a", "z"), (2, "four five", None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mixed = curriculum.mixed_documents(docs, weights=(1.0,), share=2.0)
    taken = {}
    for r in mixed.collect():
        taken[tuple(r)] = taken.get(tuple(r), 0) + 1
    assert taken == {r: 2 for r in rows}
