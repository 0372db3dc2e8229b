"""Exact top-k around pivots: the rows of a full scan, in all odd cases; what is skipped."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark.functions.vectors import cosine, doubles, norm
from evispark.operators import retrieval, search

SCHEMA = "pos int, label string, embedding array<double>"


def full_scan(index, queries, k):
    q = queries.select("query_id", doubles(F.col("query")).alias("q"))
    e = index.where(F.size("embedding") > 0).withColumn("e", doubles(F.col("embedding")))
    scored = e.crossJoin(q).withColumn("score", cosine(F.col("e"), F.col("q"), norm(F.col("e")), norm(F.col("q"))))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= k)


def found(df):
    return sorted((r["query_id"], r["rank"], r["pos"], r["label"], repr(r["score"])) for r in df.collect())


def clustered(rnd, n, groups=8, width=6, wide=0.05):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [[x + rnd.gauss(0, wide) for x in rnd.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("rows", [search.ROWS, 7])
def test_rows_of_a_full_scan(spark, monkeypatch, k, rows):
    monkeypatch.setattr(search, "ROWS", rows)
    rnd = random.Random(k)
    vectors = clustered(rnd, 200) + [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 60 + [[0.0] * 6, [], None, [1.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], [math.nan] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]]
    rnd.shuffle(vectors)
    index = spark.createDataFrame([(i, f"l{i % 3}", v) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    asked = [*clustered(rnd, 6), [2.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0] * 6, [1.0, 1.0], [1.0] * 9, [-1.0] * 6]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query array<double>")
    got = found(retrieval.top_k_per_query(index, queries, k))
    assert got == found(full_scan(index, queries, k)) and len(got) == k * len(asked)
    assert found(retrieval.top_k_per_query(index, queries, k, most=4)) == got


def test_empty_sides(spark):
    index = spark.createDataFrame([(0, "a", [1.0])], SCHEMA)
    queries = spark.createDataFrame([(0, [1.0])], "query_id int, query array<double>")
    assert retrieval.top_k_per_query(index.where("false"), queries, 3).collect() == []
    assert retrieval.top_k_per_query(index, queries.where("false"), 3).collect() == []
    assert [r["score"] for r in retrieval.top_k_per_query(spark.createDataFrame([(0, "a", [0.0])], SCHEMA), queries, 3).collect()] == [0.0]


def test_far_chunks_are_skipped(spark):
    rnd = random.Random(1)
    index = spark.createDataFrame([(i, "l", v) for i, v in enumerate(clustered(rnd, 4000, groups=40, wide=0.01))], SCHEMA)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(random.Random(1), 20, groups=40, wide=0.01))], "query_id int, query array<double>")
    report = search.Report(spark)
    got = found(retrieval.top_k_per_query(index, queries, 5, report=report))
    assert got == found(full_scan(index, queries, 5))
    assert report.pairs.value == 80_000 and report.skipped > 0.5
