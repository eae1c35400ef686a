"""What the corpus operators write on their way goes when it was read for the last time."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipwarden.llm import similarity, text
from clipwarden.llm.graph import components


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    token = text._passing.set(str(tmp_path))
    yield tmp_path
    text._passing.reset(token)


def tables(folder):
    return sorted(d for d, _, names in os.walk(folder) if any(n.endswith(".parquet") for n in names))


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark, folder):
    before, was = shuffle_files(spark), spark.conf.get(text._CLEAN)
    df = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = text.stored(df.join(df.select("k").hint("merge"), "k").repartition(3, "n"))
    left = None
    for _ in range(50):  # Spark removes them after the query, on its own time
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(text._CLEAN) == was
    assert kept.count() == 50 and kept.agg(F.sum("n")).first()[0] == 1000


def test_settled_keeps_its_rows_alone(spark, folder):
    inner = []

    def build():
        one = text.stored(spark.range(10))
        inner.append(text.settled(spark, lambda: text.stored(one.filter("id < 5"))))
        return inner[0].join(one, "id")

    got = text.settled(spark, build)
    assert sorted(r.id for r in got.collect()) == list(range(5)) and len(tables(folder)) == 1
    with pytest.raises(ZeroDivisionError):
        text.settled(spark, lambda: text.stored(spark.range(3)).filter(F.lit(1 // 0)))
    assert len(tables(folder)) == 1


def test_rounds_of_a_path_leave_the_last_one(spark, folder):
    found = components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"), "a", "b")
    assert len(tables(folder)) == 1
    assert {r.label for r in found.collect()} == {0} and found.count() == 61


def test_near_duplicates_leave_one_table(spark, folder):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(999)}" for _ in range(80))
    rows = [(i, base + f" tail{i}") for i in range(40)] + [(100 + i, f"own text {i} of few words") for i in range(5)]
    kept = similarity.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), part=8)
    assert len(tables(folder)) == 1
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, 101, 102, 103, 104]


def test_pipeline_keeps_one_stage(spark, folder, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, d, name: spark.range(8).withColumnRenamed("id", "doc_id"))
    seen = []

    def stage(s, docs, d):
        seen.append(len(tables(folder)))
        return text.stored(docs.filter("doc_id > 0").withColumn("doc_id", F.col("doc_id") - 1))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(4)])
    out = corpus_pipeline.run(spark, "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3]
    # each stage finds the table of the one before and no other
    assert seen == [0, 1, 1, 1]
