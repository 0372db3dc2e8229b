"""Retrieval, chunking, numbering, budget and prompt queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, rendering, retrieval, selection
from ..session import shared_folder
from ..sources import files
from ..sources.file_sink import write_files
from ..sources.office import read_xlsx
from ..sources.pdf_writer import make_pdf
from .base import Registered, Tables

query = Registered()
QUERIES, ORACLE_SQL = query.queries, query.oracles

_COS = "coalesce(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0)"


@query(f"SELECT a.vec_id, a.label, round({_COS}, 4) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY {_COS} DESC, a.vec_id LIMIT 40")
def retrieve_topk(t: Tables) -> DataFrame:
    q = t.embeddings.orderBy("vec_id").first()["embedding"]
    return retrieval.top_k(t.embeddings, q, 40, "vec_id").withColumn("score", F.round("score", 4)).select("vec_id", "label", "score")


_PER = f"""SELECT q.vec_id AS query_id, a.vec_id, a.label, round({_COS}, 4) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank
FROM embeddings a, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 5"""


def _per_query(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_per_query(t.embeddings, q, 5, pos="vec_id")


@query(_PER)
def retrieve_topk_per_query(t: Tables) -> DataFrame:
    return _per_query(t).select("query_id", "vec_id", "label", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH h AS ({_PER}) SELECT query_id, 'SRC' || label AS source_id, min(rank) AS first, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS snippets FROM h GROUP BY ALL""")
def retrieve_grouped(t: Tables) -> DataFrame:
    source = F.concat(F.lit("SRC"), F.col("label").cast("string"))
    hits = _per_query(t).select("query_id", source.alias("source_id"), source.alias("source_title"), "rank", "vec_id")
    grouped = retrieval.group_by_source(hits, ["query_id"], fields=("vec_id",))
    return grouped.select("query_id", "source_id", F.col("first").cast("long").alias("first"), F.array_join(F.transform("snippets", lambda x: x["vec_id"].cast("string")), ",").alias("snippets"))


@query("""SELECT source AS source_id, 'd' || doc_id AS locator, length(trim(text, ' \t\n\r')) AS n, sha256(trim(text, ' \t\n\r')) AS text_hash, 'text' AS type
FROM documents WHERE trim(text, ' \t\n\r') <> ''""")
def flatten_snippets(t: Tables) -> DataFrame:
    s = F.array(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("locator"), F.col("text"), F.lit(None).cast("string").alias("type")))
    sources = t.documents.select(F.col("source").alias("source_id"), F.col("source").alias("source_title"), s.alias("snippets"))
    flat = retrieval.flatten_snippets(sources)
    return flat.select("source_id", "locator", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_hash"), "type")


def _chunks(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("locator"), "text", F.lit("text").alias("type"))
    return chunking.chunk_snippets(docs)


_CHUNKS = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS ps
  FROM documents WHERE length(text) > 2000),
walk AS (
  SELECT doc_id, ps, 1 AS i, length(ps[1]) + 1 AS cur, 1 AS k FROM lines WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN cur + length(ps[i + 1]) + 1 > 2000 THEN length(ps[i + 1]) + 1 ELSE cur + length(ps[i + 1]) + 1 END,
         CASE WHEN cur + length(ps[i + 1]) + 1 > 2000 THEN k + 1 ELSE k END
  FROM walk WHERE i < len(ps)),
made AS (SELECT doc_id, k, string_agg(ps[i], chr(10) ORDER BY i) AS text FROM walk GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts FROM made),
every AS (
  SELECT doc_id, k AS part, 'd' || doc_id || CASE WHEN parts > 1 THEN ' (part ' || k || ')' ELSE '' END AS locator, text FROM n
  UNION ALL SELECT doc_id, 1, 'd' || doc_id, text FROM documents WHERE length(text) <= 2000)
"""


@query(_CHUNKS + "SELECT doc_id, part::BIGINT AS part, locator, length(text) AS n, sha256(text) AS text_hash FROM every")
def chunk_documents(t: Tables) -> DataFrame:
    return _chunks(t).select("doc_id", F.col("part").cast("long").alias("part"), "locator", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_hash"))


@query(_CHUNKS + "SELECT source, count(*) AS chunks, sum(length(e.text))::BIGINT AS chars, max(length(e.text)) AS longest FROM every e JOIN documents d USING (doc_id) GROUP BY source")
def chunk_stats(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", F.lit("").alias("locator"), "text", F.lit("text").alias("type"))
    return chunking.chunk_snippets(docs).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""
WITH b AS (SELECT *, (role = 'assistant')::INT AS tb FROM conversations WHERE role = 'assistant' OR trim(text, ' \t\n\r') <> ''),
n AS (SELECT *, CASE WHEN tb = 1 OR coalesce(lag(tb) OVER w, 1) = 1 THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM n)
SELECT conv_id, section::BIGINT AS section, CASE WHEN max(tb) = 1 THEN 'Table in section ' ELSE 'Section ' END || section::BIGINT AS locator,
       sha256(string_agg(trim(text, ' \t\n\r'), chr(10) ORDER BY turn)) AS text_hash FROM s GROUP BY conv_id, section
""")
def section_islands(t: Tables) -> DataFrame:
    blocks = t.conversations.withColumn("is_table", F.col("role") == "assistant")
    made = chunking.section_islands(blocks, "conv_id", "turn", "is_table", "text")
    return made.select("conv_id", "section", "locator", F.sha2("text", 256).alias("text_hash"))


@query("SELECT source AS name, lang AS kind, 'SRC' || row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, lang, source) AS source_id FROM (SELECT DISTINCT source, lang FROM documents)")
def source_numbering(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("source").alias("name"), F.col("lang").alias("kind")).distinct()
    rank = F.struct(F.when(F.col("kind") == "en", 0).otherwise(1), F.col("kind"))
    return chunking.number_sources(files, rank)


@query(r"""SELECT doc_id, '| ' || trim(replace(replace(source, '|', '\|'), chr(10), ' ')) || ' | ' || trim(replace(replace(text, '|', '\|'), chr(10), ' '), ' ' || chr(9) || chr(13)) || ' |  |' AS row
FROM documents""")
def markdown_rows(t: Tables) -> DataFrame:
    cells = F.transform(F.array("source", "text"), tx.markdown_cell)
    return t.documents.select("doc_id", tx.markdown_row(cells, F.lit(3)).alias("row"))


_BUDGET = 80_000


@query(f"""
WITH RECURSIVE s AS (
  SELECT lang, source, sum(length(text)) AS n, list(struct_pack(d := doc_id, n := length(text)) ORDER BY (CASE WHEN contains(text, '|') THEN 0 ELSE 1 END), doc_id) AS xs
  FROM documents GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) AS pos, floor({_BUDGET} / count(*) OVER (PARTITION BY lang))::BIGINT AS share, sum(n) OVER (PARTITION BY lang) AS total FROM s),
w AS (
  SELECT lang, pos, 0 AS i, {_BUDGET}::BIGINT AS rest, least(share, {_BUDGET})::BIGINT AS room, NULL::BIGINT AS kept FROM o WHERE pos = 1 AND total > {_BUDGET}
  UNION ALL
  SELECT w.lang, CASE WHEN w.i < len(o.xs) THEN w.pos ELSE w.pos + 1 END, CASE WHEN w.i < len(o.xs) THEN w.i + 1 ELSE 0 END,
    CASE WHEN w.i < len(o.xs) AND o.xs[w.i + 1].n <= w.room THEN w.rest - o.xs[w.i + 1].n ELSE w.rest END,
    CASE WHEN w.i < len(o.xs) THEN CASE WHEN o.xs[w.i + 1].n <= w.room THEN w.room - o.xs[w.i + 1].n ELSE w.room END ELSE greatest(least(o.share, w.rest), 0) END,
    CASE WHEN w.i < len(o.xs) AND o.xs[w.i + 1].n <= w.room THEN o.xs[w.i + 1].d END
  FROM w JOIN o ON o.lang = w.lang AND o.pos = w.pos)
SELECT lang, source, kept AS doc_id FROM w JOIN documents ON doc_id = kept WHERE kept IS NOT NULL
UNION ALL SELECT d.lang, d.source, d.doc_id FROM documents d JOIN o ON o.lang = d.lang AND o.source = d.source AND o.total <= {_BUDGET}
""".replace("SELECT lang, source, kept AS doc_id FROM w JOIN documents ON doc_id = kept", "SELECT w.lang AS lang, source, kept AS doc_id FROM w JOIN documents ON doc_id = kept"))
def budget_trim(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.when(F.contains("text", F.lit("|")), 0).otherwise(1).alias("k"))
    return selection.first_fit(rows, ["lang"], ["source"], ["k", "doc_id"], "n", _BUDGET).select("lang", "source", "doc_id")


_GENERIC = "CASE WHEN trim({m}) = '' OR regexp_matches(lower({m}), 'to be determined|placeholder|tbd') THEN {s} ELSE {s} || ' — ' || {m} END"
_MECH = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'TBD later' WHEN 2 THEN p_type ELSE p_brand || ' Placeholder' END"


@query(f"SELECT p_partkey, {_GENERIC.format(s='p_name', m='(' + _MECH + ')')} AS query, p_brand || ': ' || p_name || ' — ' || p_type AS item_query, 'Learning domain: ' || p_name AS domain_query FROM part")
def rag_query_text(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", selection.solution_query(F.col("p_name"), F.expr(_MECH)).alias("query"),
        selection.item_query(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("item_query"), selection.domain_query(F.col("p_name")).alias("domain_query"),
    )


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def iso_lookup_fallback(t: Tables) -> DataFrame:
    found = selection.lookup_with_fallback(t.customer, t.nation, "c_nationkey", "n_nationkey", "n_name", "country")
    return found.select("c_custkey", "country")


@query("SELECT r_name AS country_name, c_mktsegment AS label, 0 AS score FROM region, (SELECT DISTINCT c_mktsegment FROM customer)")
def dim_cartesian(t: Tables) -> DataFrame:
    dims = t.customer.select(F.col("c_mktsegment").alias("label")).distinct()
    return t.region.select(F.col("r_name").alias("country_name")).crossJoin(F.broadcast(dims) if dims.limit(10_001).count() <= 10_000 else dims).withColumn("score", F.lit(0))


@query("""WITH s AS (SELECT source AS source_id, sum((n_chars > 8000)::INT)::BIGINT AS n FROM documents GROUP BY 1), f AS (SELECT * FROM s WHERE n > 0), b AS (SELECT * FROM s WHERE n = 0)
SELECT source_id AS batch, source_id, n FROM f UNION ALL SELECT f.source_id, b.source_id, b.n FROM f, b""")
def source_batches(t: Tables) -> DataFrame:
    sources = t.documents.groupBy(F.col("source").alias("source_id")).agg(F.collect_list(F.when(F.col("n_chars") > 8000, F.col("doc_id"))).alias("snippets"))
    return selection.source_batches(sources).select("batch", "source_id", F.size("snippets").cast("long").alias("n"))


_W = "least(greatest(12, greatest(max(length({c})), length('{c}')) + 2), 60)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_W.format(c=c)}::INTEGER AS width FROM part" for c in ("p_name", "p_brand", "p_type")))
def column_widths(t: Tables) -> DataFrame:
    return rendering.column_widths(t.part, ["p_name", "p_brand", "p_type"])


@query("""SELECT source, lang, string_agg(CASE WHEN doc_id % 3 = 0 THEN concat_ws(' | ', source, 'd' || doc_id) ELSE concat_ws(' | ', source, 'd' || doc_id, 'http://x/' || doc_id) END, chr(10) ORDER BY doc_id) AS citations,
string_agg(doc_id::VARCHAR, '; ' ORDER BY doc_id) AS tags FROM documents GROUP BY source, lang""")
def flat_citations(t: Tables) -> DataFrame:
    c = F.struct(
        "doc_id", F.col("source").alias("source_title"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("locator"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("source_url"),
    )
    g = t.documents.groupBy("source", "lang").agg(F.array_sort(F.collect_list(c)).alias("c"))
    return g.select("source", "lang", rendering.flat_citations(F.col("c")).alias("citations"), rendering.joined(F.transform("c", lambda x: x["doc_id"].cast("string"))).alias("tags"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_\s-]', '', 'g'), '[\s_-]+', '_', 'g') AS slug FROM part")
def slugify_titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"))


_PRINTED = """WITH p AS (SELECT p_brand || '-' || p_partkey // 1000 AS source, *, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) - 1 AS n FROM part),
g AS (SELECT source, n // 12 + 1 AS page, n % 12 // 6 + 1 AS k, string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |', chr(10) ORDER BY n) AS cells, string_agg(p_partkey || ' ' || p_name || ' ' || p_type, chr(10) ORDER BY n) AS said FROM p GROUP BY ALL)
SELECT source, CASE WHEN max(k) OVER (PARTITION BY source, page) > 1 THEN 'Table ' || k || ' on p. ' || page ELSE 'Table on p. ' || page END AS locator, 'table' AS type, '| key | name | type |' || chr(10) || '| --- | --- | --- |' || chr(10) || cells AS text FROM g
UNION ALL SELECT source, 'p. ' || page, 'text', source || ', page ' || page || chr(10) || string_agg('key name type' || chr(10) || said, chr(10) ORDER BY k) FROM g GROUP BY source, page"""


@query(_PRINTED)
def scan_pdf(t: Tables) -> DataFrame:
    """Parts printed to files of ruled tables, a file per brand and thousand keys, and read again."""

    def printed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_partkey")
        source, pages = rows["source"].iloc[0], []
        cells = [["key", "name", "type"], *rows[["p_partkey", "p_name", "p_type"]].astype(str).values.tolist()]
        for n, i in enumerate(range(1, len(cells), 12), start=1):
            page = cells[i : i + 12]
            pages.append([(f"{source}, page {n}", None), *((None, [cells[0], *page[j : j + 6]]) for j in range(0, len(page), 6))])
        return pd.DataFrame({"path": [f"{source}.pdf"], "content": [make_pdf(pages)]})

    source = F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string"))
    made = t.part.select(source.alias("source"), "p_partkey", "p_name", "p_type").groupBy("source").applyInPandas(printed, "path string, content binary")
    return files.snippets_of(files.read_blocks(made)).select(F.regexp_extract("path", r"(.*)\.pdf$", 1).alias("source"), "locator", "type", "text")


_ENTRIES = "SELECT p_brand || '-' || p_partkey // 1000 AS source, *, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey)::INTEGER AS n FROM part"


def _evidence_outputs(t: Tables) -> DataFrame:
    """An output per brand and thousand keys, an entry per part: some without a mechanism, some without citations."""
    i = F.col("p_partkey")
    cited = F.array(F.struct(F.col("p_name").alias("source_title"), F.concat(F.lit("p. "), F.col("p_size").cast("string")).alias("locator")))
    evidence = F.struct(F.lit("low").alias("quality"), F.lit("a <b> & c").alias("rationale"), F.when(i % 4 == 0, F.slice(cited, 1, 0)).otherwise(cited).alias("citations"))
    entry = F.struct(i.cast("string").alias("solution_id"), F.col("p_name").alias("solution"), F.when(i % 3 > 0, F.col("p_type")).alias("mechanism"), evidence.alias("evidence"), F.array(F.col("p_type"), F.col("p_brand")).alias("risks"))
    source = F.concat_ws("-", "p_brand", F.floor(i / 1000).cast("string"))
    listed = t.part.groupBy(source.alias("name")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("es"))
    return listed.select("name", F.to_json(F.struct(F.col("es")["e"].alias("solutions"))).alias("json"))


@query(f"""WITH e AS ({_ENTRIES}) SELECT source, 0 AS n, 'solution_id|solution|mechanism|feasibility_resource_constrained|evidence_quality|evidence_rationale|citations|risks|implementation_notes' AS cells FROM e GROUP BY source
UNION ALL SELECT source, n, concat_ws('|', p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END, '', 'low', 'a <b> & c', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ' | p. ' || p_size END, p_type || '; ' || p_brand, '') FROM e""")
def render_workbooks(t: Tables) -> DataFrame:
    """Workbooks rendered and written by the tasks, then read again."""
    folder = f"{shared_folder(t.spark)}/workbooks-{uuid.uuid4().hex}"
    write_files(rendering.files(_evidence_outputs(t), "rrr_evidence_matrix", "xlsx"), folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = read_xlsx(bytes(content))
                yield pd.DataFrame({"path": path, "n": range(len(rows)), "cells": ["|".join(x or "" for x in r) for r in rows]})

    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(folder)
    found = found.select("path", "content").mapInPandas(read, "path string, n int, cells string")
    name = F.call_function("try_url_decode", F.regexp_extract("path", r"([^/]+)\.xlsx$", 1))  # paths are addresses
    return found.select(name.alias("source"), "n", "cells")


@query(f"""WITH e AS ({_ENTRIES}) SELECT source AS name, n, p_partkey::VARCHAR AS solution_id, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END AS mechanism, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ' | p. ' || p_size END AS citations, p_type || '; ' || p_brand AS risks FROM e""")
def flat_sheets(t: Tables) -> DataFrame:
    rows = rendering.sheets(_evidence_outputs(t), "rrr_evidence_matrix").select("name", F.posexplode(F.col("sheets")[0]["rows"]).alias("n", "r")).where("n > 0")
    return rows.select("name", "n", *(F.col("r")[i].alias(c) for i, c in ((0, "solution_id"), (2, "mechanism"), (6, "citations"), (7, "risks"))))
