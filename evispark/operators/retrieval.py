"""Snippets, their vectors, exact cosine top-k, and regrouping by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import cosine, doubles, norm
from .search import Report, nearest


def flatten_snippets(sources: DataFrame) -> DataFrame:
    """sources (source_id, source_title, snippets array) as one row per snippet with text, in order: adds ``pos``."""
    rows = sources.select("source_id", "source_title", F.posexplode("snippets").alias("pos", "s"))
    rows = rows.select("source_id", "source_title", "pos", F.col("s.locator").alias("locator"), strip(F.col("s.text")).alias("text"), F.coalesce("s.type", F.lit("text")).alias("type"))
    return rows.where(F.coalesce(F.col("text"), F.lit("")) != "")


def build_index(snippets: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Snippets with their vectors (joined on ``key``) and the vectors' lengths, computed once and not per query."""
    v = vectors.select(*key, doubles(F.col("embedding")).alias("embedding"))
    return snippets.join(v, key).withColumn("norm", norm(F.col("embedding")))


def with_vector(index: DataFrame) -> DataFrame:
    return index.where(F.size("embedding") > 0)


def top_k(index: DataFrame, query: list[float], k: int = 20, pos: str = "pos") -> DataFrame:
    """The k most similar rows to one query vector: ``score`` unrounded, ties by ``pos``; the vector is dropped.

    Plans as TakeOrderedAndProject: each task keeps k rows.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    e = doubles(F.col("embedding"))
    scored = with_vector(index).withColumn("score", cosine(e, q, F.col("norm") if "norm" in index.columns else None))
    return scored.drop("embedding", "norm").orderBy(F.desc("score"), pos).limit(k)


def top_k_per_query(index: DataFrame, queries: DataFrame, k: int = 20, query_id: str = "query_id", pos: str = "pos", most: int = 2_000, report: Report | None = None) -> DataFrame:
    """The k most similar rows for each row of ``queries`` (query_id, query array): adds ``score`` and ``rank``.

    The result is that of a full scan; whole chunks that can't hold one of a query's k best are skipped (see ``search``;
    ``report`` counts them). Up to ``most`` queries are sent to all tasks; beyond it they are taken in blocks of about
    that many, one after another, so what is sent is bounded. Query ids are different and not null.
    """
    blocks = -(-queries.count() // most) or 1
    parts = [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, (nearest(index, part, k, query_id, pos, report) for part in parts))


def group_by_source(hits: DataFrame, query: list[str] | None = None, rank: str = "rank", fields: tuple[str, ...] = ("locator", "text", "type")) -> DataFrame:
    """Hits regrouped: a row per query and source with the rank of its first hit, the title of that, and its snippets in rank order.

    A query has at most k hits, so its snippets are few.
    """
    query = query or []
    grouped = hits.groupBy(*query, "source_id").agg(
        F.min(rank).alias("first"), F.min_by("source_title", rank).alias("source_title"), F.array_sort(F.collect_list(F.struct(rank, *fields))).alias("s")
    )
    return grouped.select(*query, "first", "source_id", "source_title", F.transform("s", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("snippets"))
