"""Merge queries: conversations as partial outputs, turns as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import merging
from .base import Registered, Tables

query = Registered()
QUERIES, ORACLE_SQL = query.queries, query.oracles

_PARTS = "p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {x} AS x FROM conversations)"


@query("WITH RECURSIVE " + _PARTS.format(x="coalesce(text, '')") + """,
w AS (SELECT conv_id, i, x AS acc FROM p WHERE i = 1 UNION ALL
  SELECT w.conv_id, p.i, CASE WHEN p.x = '' OR p.x = acc THEN acc WHEN acc = '' THEN p.x ELSE acc || chr(10) || chr(10) || p.x END FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1)
SELECT conv_id, arg_max(acc, i) AS text FROM w GROUP BY conv_id""")
def merge_text(t: Tables) -> DataFrame:
    parts = t.conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("batch"), F.lit(0).alias("pos"), "text")
    return merging.merge_items(parts, "conv_id", ("text",)).select(F.col("conv_id").cast("long").alias("conv_id"), "text")


@query("WITH RECURSIVE " + _PARTS.format(x="string_split(text, ' ')") + """,
w AS (SELECT conv_id, i, x AS acc FROM p WHERE i = 1 UNION ALL
  SELECT w.conv_id, p.i, CASE WHEN len(acc) = 0 THEN p.x ELSE acc || list_transform(list_filter(list_transform(range(1, len(p.x) + 1), lambda k: {'k': k, 'v': p.x[k]}), lambda e: NOT list_contains(acc, e.v) AND list_position(p.x, e.v) = e.k), lambda e: e.v) END
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1)
SELECT conv_id, array_to_string(arg_max(acc, i), '|') AS tags FROM w GROUP BY conv_id""")
def merge_arrays(t: Tables) -> DataFrame:
    parts = t.conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("batch"), F.lit(0).alias("pos"), F.split("text", " ").alias("tags"))
    merged = merging.merge_items(parts, "conv_id", (), ("tags",))
    return merged.select(F.col("conv_id").cast("long").alias("conv_id"), F.array_join("tags", "|").alias("tags"))


_LEVEL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' WHEN toxic = 1 THEN 'low' ELSE 'none' END"


@query(f"""WITH e AS (SELECT d.source, d.lang, d.doc_id, {_LEVEL} AS q FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, CASE q WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS k FROM e)
SELECT source, lang, arg_max(q, k) AS quality, count(*) FILTER (k > 0) AS n_some,
  string_agg('r' || doc_id, ' ' ORDER BY doc_id) FILTER (k > 0) AS rationale,
  string_agg(DISTINCT 'd' || doc_id % 7, ',' ORDER BY 'd' || doc_id % 7) FILTER (k > 0) AS cited FROM r GROUP BY source, lang HAVING max(k) > 0""")
def merge_evidence_quality(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    cite = F.struct(F.lit("s").alias("source_id"), F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("locator"), F.lit(None).cast("string").alias("source_title"))
    e = F.struct(F.expr(_LEVEL).alias("quality"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("rationale"), F.array(cite).alias("citations"))
    parts = d.select("source", "lang", F.col("doc_id").alias("batch"), F.lit(0).alias("pos"), e.alias("evidence"), F.lit("i").alias("item"))
    merged = merging.merge_items(parts, "item", evidence_col="evidence", group=("source", "lang"))
    n = parts.where("evidence.quality <> 'none'").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_some"))
    cited = F.array_join(F.array_sort(F.transform("evidence.citations", lambda c: c["locator"])), ",")
    return merged.join(n, ["source", "lang"]).select("source", "lang", "evidence.quality", "n_some", "evidence.rationale", cited.alias("cited"))


@query("""WITH p AS (SELECT role AS item, conv_id % 3 AS grp, min(struct_pack(b := turn, p := conv_id)) AS f, count(*) AS n FROM conversations GROUP BY ALL)
SELECT grp, item, f.b AS batch, f.p AS pos, row_number() OVER (PARTITION BY grp ORDER BY f) AS place FROM p""")
def merge_first_order(t: Tables) -> DataFrame:
    parts = t.conversations.select((F.col("conv_id") % 3).alias("grp"), F.col("role").alias("item"), F.col("turn").alias("batch"), F.col("conv_id").alias("pos"))
    merged = merging.merge_items(parts, "item", group=("grp",))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("item_order")).cast("long")
    return merged.select("grp", "item", "item_order.batch", "item_order.pos", place.alias("place"))


_OBJECTS = """WITH e AS (SELECT source AS item, n_chars AS batch, doc_id AS pos, unnest([{'k': lang, 'n': doc_id % 50}, {'k': lang, 'n': n_chars % 30}, {'k': lang, 'n': doc_id % 50}]) AS v, unnest([0, 1, 2]) AS j FROM documents),
f AS (SELECT *, min(struct_pack(b := batch, p := pos)) OVER (PARTITION BY item, v) AS first FROM e)
SELECT item, string_agg(v.k || v.n, ',' ORDER BY batch, pos, j) AS risks, count(*) AS n FROM f WHERE first = struct_pack(b := batch, p := pos) GROUP BY item"""


@query(_OBJECTS)
def merge_objects(t: Tables) -> DataFrame:
    v = lambda n: F.struct(F.col("lang").alias("k"), n.alias("n"))
    risks = F.array(v(F.col("doc_id") % 50), v(F.col("n_chars") % 30), v(F.col("doc_id") % 50))
    parts = t.documents.select(F.col("source").alias("item"), F.col("n_chars").alias("batch"), F.col("doc_id").alias("pos"), risks.alias("risks"))
    merged = merging.merge_items(parts, "item", (), ("risks",))
    shown = F.transform("risks", lambda x: F.concat(x["k"], x["n"].cast("string")))
    return merged.select("item", F.array_join(shown, ",").alias("risks"), F.size("risks").cast("long").alias("n"))


@query("SELECT source, lang, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, lang, n_chars")
def dedup_citations(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    return merging.first_citations(d.withColumn("n", F.col("n_chars").cast("string")), "doc_id", ("source", "lang", "n")).drop("n").select("source", "lang", "n_chars", "doc_id")


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_group(t: Tables) -> DataFrame:
    found = merging.latest_per_group(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id")
    return found.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
