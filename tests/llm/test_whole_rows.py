"""Queries keep all rows: their SQL on tables with repeated ids, orphans and nulls."""

import pytest

from clipwarden.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    vectors = [(50, [1.0, 1.0]), (1, [2.0, 2.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (2, [1.0, 0.5]), (50, [0.5, -1.0]), (3, None), (None, [9.0, 9.0]), (100, [0.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "assistant", "ok"), (1, 2, "user", "find"), (1, 2, "user", "again"), (1, 3, "assistant", "done"), (1, 3, "assistant", "also"),
        (2, 0, "assistant", "first without a call"), (2, 5, "assistant", "late"), (2, 6, "user", None), (3, 4, "tool", "x"), (None, 1, "user", "lost"), (4, None, "user", "lost"),
        (5, 1, None, "no role"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name, table", [("op9_top_k", "embeddings"), ("op7_tool_calls", "conversations")])
def test_equals_its_sql(spark, folder, name, table):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    rows = [tuple(list(v) if isinstance(v, list) else v for v in r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    if name == "op9_top_k":
        assert sum(r["vec_id"] == 1 for r in got.filter("query_id = 100").collect()) == 3
    else:
        assert [r["problems"] for r in got.filter("conv = 2").orderBy("position").collect()][-1] == ["no call"]


def test_empty_conversations(spark, folder):
    from clipwarden.llm import tool_calls

    calls, results = queries.calls_of(spark.read.parquet(f"{folder}/conversations.parquet").limit(0))
    assert tool_calls.format_calls(calls, results, queries.TOOLS).count() == 0
