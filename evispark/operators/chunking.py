"""Snippets into bounded chunks; runs of paragraphs between tables; numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

MAX_CHARS = 2000


def pack_paragraphs(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Array of chunks: paragraphs (split at blank lines, else at lines) packed greedily, each costing its length + 1.

    A paragraph longer than the limit is a chunk of its own; blank ones are dropped.
    """
    double = F.split(text, "\n\n")
    paragraphs = F.when(F.size(double) > 1, double).otherwise(F.split(text, "\n"))
    paragraphs = F.filter(F.transform(paragraphs, strip), lambda p: p != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr("cast(array() as array<string>)").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        cost = F.length(p) + 1
        flush = (a["n"] > 0) & (a["n"] + cost > max_chars)
        return F.struct(
            F.when(flush, F.array_append(a["done"], F.array_join(a["cur"], "\n"))).otherwise(a["done"]).alias("done"),
            F.when(flush, F.array(p)).otherwise(F.array_append(a["cur"], p)).alias("cur"),
            F.when(flush, cost).otherwise(a["n"] + cost).alias("n"),
        )

    return F.aggregate(
        paragraphs, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.array_join(a["cur"], "\n"))).otherwise(a["done"])
    )


def chunk_snippets(snippets: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows (…, locator, text, type) with long texts split; adds ``part`` from 1. Tables pass whole.

    The locator gets `` (part k)`` only where there are several chunks. Map-side: no shuffle.
    """
    long = (F.col("type") != "table") & (F.length("text") > max_chars)
    rows = snippets.withColumn("__chunks", F.when(long, pack_paragraphs(F.col("text"), max_chars)).otherwise(F.array("text")))
    rest = [c for c in snippets.columns if c not in ("locator", "text")]
    rows = rows.select(*rest, "locator", F.size("__chunks").alias("__n"), F.posexplode("__chunks").alias("__i", "text"))
    locator = F.when(F.col("__n") > 1, F.concat("locator", F.lit(" (part "), (F.col("__i") + 1).cast("string"), F.lit(")"))).otherwise(F.col("locator"))
    return rows.withColumn("locator", locator).withColumn("part", F.col("__i") + 1).drop("__n", "__i")


def section_islands(blocks: DataFrame, doc: str, pos: str, is_table: str, text: str) -> DataFrame:
    """Sections of a document: runs of paragraphs between tables joined by lines, tables for themselves.

    One counter numbers both: ``Section n``, ``Table in section n``. Blank paragraphs are dropped first.
    """
    rows = blocks.where(F.col(is_table) | (strip(F.col(text)) != ""))
    w = Window.partitionBy(doc).orderBy(pos)
    table = F.col(is_table).cast("int")
    new = F.when((table == 1) | (F.coalesce(F.lag(table).over(w), F.lit(1)) == 1), 1).otherwise(0)
    rows = rows.withColumn("__new", new).withColumn("section", F.sum("__new").over(w))
    joined = rows.groupBy(doc, "section").agg(F.max(is_table).alias("is_table"), F.array_sort(F.collect_list(F.struct(pos, text))).alias("__t"), F.min(pos).alias("first_pos"))
    locator = F.when(F.col("is_table"), F.lit("Table in section ")).otherwise(F.lit("Section "))
    return joined.select(
        doc, "section", "is_table", "first_pos", F.concat(locator, F.col("section").cast("string")).alias("locator"),
        F.array_join(F.transform("__t", lambda x: strip(x[text])), "\n").alias("text"),
    )


def number_sources(files: DataFrame, kind_rank: Column, name: str = "name") -> DataFrame:
    """Ids SRC1, SRC2, … by kind and then file name. For file listings: the numbers need one order over all rows."""
    w = Window.orderBy(kind_rank, F.col(name))
    return files.withColumn("source_id", F.concat(F.lit("SRC"), F.row_number().over(w).cast("string")))


def number_tables(tables: DataFrame, doc: str, page: str, pos: str) -> DataFrame:
    """Locators of page tables: numbered only if a page has several."""
    w = Window.partitionBy(doc, page)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(pos))
    p = F.col(page).cast("string")
    return tables.withColumn("locator", F.when(n > 1, F.concat(F.lit("Table "), k.cast("string"), F.lit(" on p. "), p)).otherwise(F.concat(F.lit("Table on p. "), p)))
