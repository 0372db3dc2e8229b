"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checked_broadcast, materialise, numbered, without


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = lambda text: F.unhex(F.md5(text)),
) -> DataFrame:
    """One row per row of ``docs``: ``row_no``, id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    1. A row of two digests per document is written (no text). Hashes that occur once are settled by it.
    2. Texts whose hash occurs again are grouped by (hash, text): grouping keys are compared byte by byte, so
       a collision of hashes gives two groups. Equal texts are combined before the shuffle, so a group of any
       size costs a row per task. Texts of other documents aren't shuffled while the repeated hashes are few
       enough to broadcast; beyond that the join shuffles.

    Defined results: null text is the empty text; null ids come after all others; of repeated rows with
    one id the first in the input stays (``row_no`` tells them apart); an empty table gives no rows; other
    columns are ignored. ``row_no`` is the row's place in the files (see ``numbered``).
    """
    rows = numbered(docs, F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    rows = rows.withColumn("h", content_hash(F.col("t")))
    digests = materialise(rows.select("row_no", "id", "h", F.sha2("t", 256).alias("sha")))
    again = digests.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = checked_broadcast(materialise(again))
    classes = (
        rows.join(again, "h", "left_semi")
        .groupBy("h", "t")
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_no")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("h", F.sha2("t", 256).alias("sha"), "first", "n")
    )
    # A text is its (hash, SHA-256) from here on; grouping has already told apart texts that share the hash.
    joined = digests.join(classes, ["h", "sha"], "left")
    first = F.col("first")
    return joined.select(
        "row_no",
        F.col("id").alias(id_col),
        F.when(first.isNull(), F.col("id")).otherwise(first["id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (first.isNull() | (first["row_no"] == F.col("row_no"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another's text; all columns stay, whatever their names.

    Nulls, ties and repeated rows as in ``exact_dedup``; an empty table stays empty.
    """
    return without(docs, lambda d: exact_dedup(d, id_col, text_col).where("NOT kept"))
