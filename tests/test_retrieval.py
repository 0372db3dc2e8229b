import pytest
from pyspark.sql import functions as F

from evispark.functions.vectors import cosine
from evispark.operators import retrieval


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row["c"] == pytest.approx(expected)


def index(spark, rows):
    return spark.createDataFrame(rows, "pos int, source_id string, source_title string, locator string, text string, type string, embedding array<float>")


def test_top_k_order_ties_and_missing_vectors(spark):
    rows = [(i, f"S{i % 3}", "T", f"p{i}", "x", "text", [1.0, 0.0]) for i in range(50)] + [(50, "S9", "T", "p", "x", "text", []), (51, "S9", "T", "p", "x", "text", None)]
    found = retrieval.top_k(index(spark, rows), [1.0, 0.0], 5).collect()
    assert [r["pos"] for r in found] == [0, 1, 2, 3, 4] and "embedding" not in found[0].asDict()


def test_best_first(spark):
    rows = [(0, "A", "a", "1", "x", "text", [0.0, 1.0]), (1, "B", "b", "2", "y", "table", [1.0, 0.0]), (2, "A", "a2", "3", "z", "text", [1.0, 1.0])]
    found = retrieval.top_k(index(spark, rows), [1.0, 0.0], 10).collect()
    assert [r["pos"] for r in found] == [1, 2, 0]


def test_per_query_in_blocks_and_groups(spark):
    rows = [(0, "A", "a", "1", "x", "text", [0.0, 1.0]), (1, "B", "b", "2", "y", "table", [1.0, 0.0]), (2, "A", "a2", "3", "z", "text", [1.0, 1.0])]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query array<double>")
    whole = retrieval.top_k_per_query(index(spark, rows), q, 2).collect()
    parts = retrieval.top_k_per_query(index(spark, rows), q, 2, most=1).collect()
    key = lambda r: (r["query_id"], r["rank"], r["pos"])
    assert sorted(map(key, whole)) == sorted(map(key, parts)) == [(1, 1, 1), (1, 2, 2), (2, 1, 0), (2, 2, 2)]
    grouped = retrieval.group_by_source(spark.createDataFrame([(1, "SRC1", "t1", "a", "x", "text"), (2, "SRC2", "t2", "b", "y", "text"), (3, "SRC1", "t3", "c", "z", "text")], "rank int, source_id string, source_title string, locator string, text string, type string")).collect()
    assert [(g["source_id"], g["source_title"], [s["locator"] for s in g["snippets"]]) for g in grouped] == [("SRC1", "t1", ["a", "c"]), ("SRC2", "t2", ["b"])]


def test_flatten_and_index(spark):
    s = "array<struct<locator string, text string, type string>>".replace(" string", ":string")
    sources = spark.createDataFrame([("S1", "t", [("a", "  x ", None), ("b", " \n", "text"), ("c", None, "text"), ("d", "y", "table")]), ("S2", "u", [])], f"source_id string, source_title string, snippets {s}")
    flat = retrieval.flatten_snippets(sources)
    assert [(r["pos"], r["text"], r["type"]) for r in flat.orderBy("pos").collect()] == [(0, "x", "text"), (3, "y", "table")]
    vectors = spark.createDataFrame([("S1", 0, [3.0, 4.0])], "source_id string, pos int, embedding array<float>")
    assert retrieval.build_index(flat, vectors, ["source_id", "pos"]).first()["norm"] == 5.0
