"""Validation, citation and status queries; extraction, stubs and prompts over specifications made of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, stubs, validation
from ..plans import countries, prompts, schema
from ..sources import sinks
from .base import Registered, Tables

query = Registered()
QUERIES, ORACLE_SQL = query.queries, query.oracles

_CITE = "WITH c AS (SELECT doc_id, source AS source_id FROM documents), a AS (SELECT DISTINCT source AS source_id FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0) "


def _cited(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.documents.select("doc_id", F.col("source").alias("source_id"))
    allowed = validation.allowed_ids(t.documents.where("cast(substr(source, 4) as int) % 2 = 0").select(F.col("source").alias("source_id")))
    return c, allowed


@query(_CITE + "SELECT source_id, doc_id FROM c WHERE source_id NOT IN (SELECT source_id FROM a)")
def allowed_source_violations(t: Tables) -> DataFrame:
    return validation.source_violations(*_cited(t))


@query(_CITE + "SELECT source_id, doc_id FROM c WHERE source_id IN (SELECT source_id FROM a)")
def allowed_source_valid(t: Tables) -> DataFrame:
    return validation.allowed_only(*_cited(t))


_BLANKED = "CASE WHEN page_id % 6 = 0 THEN '  ' ELSE 'S' || page_id END"
_DATE = "CASE WHEN page_id % 5 = 0 THEN '2024-1-1' ELSE '2024-13-45' END"


def _citation():
    s = lambda e, n: F.expr(e).cast("string").alias(n)
    fields = {"source_id": _BLANKED, "reference": "NULL", "authors": "'A'", "doi": "CASE WHEN page_id % 7 = 0 THEN '10.1/x' END", "isbn": "''", "publisher": "' '", "quote": "'q'", "source_type": "'web'", "published_date": _DATE}
    return F.struct(F.col("url").alias("source_url"), *(s(v, k) for k, v in fields.items()))


@query(f"""SELECT page_id, CASE WHEN url LIKE 'http%' AND url NOT LIKE '%example.com%' THEN url END AS source_url,
{_BLANKED} AS source_id, CASE WHEN page_id % 7 = 0 THEN '10.1/x' END AS doi, NULL::VARCHAR AS publisher,
CASE WHEN regexp_full_match({_DATE}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {_DATE} END AS published_date FROM pages""")
def citation_clean(t: Tables) -> DataFrame:
    c = t.pages.select("page_id", validation.clean_citations(F.array(_citation()))[0].alias("c"))
    return c.select("page_id", "c.source_url", "c.source_id", "c.doi", "c.publisher", "c.published_date")


@query(f"""SELECT page_id, trim({_BLANKED}) <> '' OR regexp_matches(u, '^https?://[^/?#]+') OR page_id % 7 = 0 AS identified, page_id % 7 = 0 AS any_present
FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'ftp' || substr(url, 5) ELSE url END AS u FROM pages)""")
def citation_identifier(t: Tables) -> DataFrame:
    c = t.pages.withColumn("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("ftp"), F.substr("url", F.lit(5)))).otherwise(F.col("url")))
    c = c.select("page_id", _citation().alias("c"))
    present = validation.any_present(F.col("c.reference"), F.col("c.doi"))
    return c.select("page_id", validation.identified(F.col("c")).alias("identified"), present.alias("any_present"))


@query("""WITH v AS (
 SELECT doc_id, '$.quality: enum' AS path FROM labels WHERE quality NOT IN (1) UNION ALL SELECT doc_id, '$.toxic: maximum' FROM labels WHERE toxic > 0
 UNION ALL SELECT doc_id, '$.lang: pattern' FROM documents WHERE NOT regexp_matches(lang, '^[d-f]') UNION ALL SELECT doc_id, '$.text: maxLength' FROM documents WHERE length(text) > 5000
 UNION ALL SELECT doc_id, '$.source: const' FROM documents WHERE source <> 'src1') SELECT doc_id, path FROM v""")
def schema_violations(t: Tables) -> DataFrame:
    labels = {"$.quality: enum": validation.enum(F.col("quality"), [1]), "$.toxic: maximum": validation.between(F.col("toxic"), 0, 0), "$.doc_id: required": validation.required(F.col("doc_id"))}
    docs = {"$.lang: pattern": validation.pattern(F.col("lang"), "^[d-f]"), "$.text: minLength": validation.non_empty(F.col("text")), "$.text: maxLength": F.length("text") <= 5000, "$.source: const": validation.const(F.col("source"), "src1")}
    return validation.violations(t.labels, labels, ["doc_id"]).unionByName(validation.violations(t.documents, docs, ["doc_id"]))


#: A closed schema with references, evidence of one of two forms, and citations that need an identifier.
_TEXT = {"$ref": "#/$defs/Text"}
_CLOSED = {
    "type": "object", "additionalProperties": False, "required": ["job", "lang", "source", "text", "n", "evidence"],
    "properties": {
        "job": {"const": "x"}, "lang": {"type": "string"}, "source": {"type": "string", "pattern": "^src[0-9]$"}, "text": {"type": "string", "maxLength": 5000}, "n": {"type": "integer", "minimum": 0, "maximum": 4000},
        "evidence": {"oneOf": [{"$ref": "#/$defs/Note"}, {"$ref": "#/$defs/Nothing"}]},
    },
    "$defs": {
        "Text": {"type": "string", "minLength": 1},
        "Cited": {"type": "object", "additionalProperties": False, "required": ["source_title", "locator"], "properties": {"source_title": _TEXT, "locator": _TEXT, "source_id": _TEXT, "doi": _TEXT}, "anyOf": [{"required": ["source_id"]}, {"required": ["doi"]}]},
        "Note": {"type": "object", "additionalProperties": False, "required": ["quality", "rationale"], "properties": {"quality": {"enum": ["high", "medium", "low"]}, "rationale": _TEXT, "citations": {"type": "array", "items": {"$ref": "#/$defs/Cited"}}}},
        "Nothing": {"type": "object", "additionalProperties": False, "required": ["quality", "rationale"], "properties": {"quality": {"const": "none"}, "rationale": _TEXT, "citations": {"type": "array", "maxItems": 0}}},
    },
}


def _outputs(t: Tables) -> DataFrame:
    """An output per document: some with another job, without a language, with a field too many, with evidence of neither form."""
    i = F.col("doc_id")
    cited = F.struct(F.lit("t").alias("source_title"), F.lit("l").alias("locator"), F.when(i % 6 < 4, "S").alias("source_id"))
    some = F.when(i % 3 == 0, F.slice(F.array(cited), 1, 0)).when(i % 3 == 1, F.array(cited)).otherwise(F.array(cited, cited))
    quality = F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), (i % 4 + 1).cast("int"))
    evidence = F.struct(quality.alias("quality"), F.when(i % 5 == 0, "").otherwise("r").alias("rationale"), some.alias("citations"))
    fields = F.struct(F.when(i % 7 == 0, "y").otherwise("x").alias("job"), F.when(i % 13 != 0, F.col("lang")).alias("lang"), "source", F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").alias("n"), F.when(i % 11 == 0, 1).alias("extra"), evidence.alias("evidence"))
    return t.documents.select("doc_id", F.to_json(fields).alias("json"))


@query("""WITH d AS (SELECT *, doc_id % 4 = 0 AS none, doc_id % 5 <> 0 AS said, doc_id % 3 AS n_cited FROM documents)
SELECT doc_id, '$.job' AS path FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, '$' FROM d WHERE doc_id % 13 = 0 OR lang IS NULL UNION ALL SELECT doc_id, '$' FROM d WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, '$.source' FROM d WHERE NOT regexp_full_match(source, 'src[0-9]') UNION ALL SELECT doc_id, '$.text' FROM d WHERE length(text) > 5000 UNION ALL SELECT doc_id, '$.n' FROM d WHERE n_chars > 4000
UNION ALL SELECT doc_id, '$.evidence' FROM d WHERE NOT (said AND CASE WHEN none THEN n_cited = 0 ELSE n_cited = 0 OR doc_id % 6 < 4 END)""")
def schema_document(t: Tables) -> DataFrame:
    found = schema.schema_errors(_outputs(t), _CLOSED, key=("doc_id",))
    return found.select("doc_id", F.substring_index("error", ": ", 1).alias("path"))


@query("SELECT doc_id, (quality = 1) OR (toxic = 0) AS valid FROM labels")
def evidence_union_check(t: Tables) -> DataFrame:
    cites = F.when(F.col("toxic") == 1, F.array(F.lit("c"))).otherwise(F.expr("cast(array() as array<string>)"))
    e = F.struct(F.when(F.col("quality") == 1, "high").otherwise("none").alias("quality"), F.lit("r").alias("rationale"), cites.alias("citations"))
    return t.labels.select("doc_id", validation.evidence_union(e).alias("valid"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'SKIP' ELSE 'FAILED' END AS status, count(*) AS n, o_orderstatus <> 'F' AS failed FROM orders GROUP BY ALL")
def status_summary(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "SKIP").otherwise("FAILED")
    return sinks.status_summary(t.orders.select(status.alias("status")))


@query("""WITH r AS (SELECT o_orderpriority AS job_id, n_name AS country_iso3, strftime(o_orderdate, '%Y%m') AS run, o_orderstatus <> 'F' AS failed, floor(o_totalprice)::BIGINT % 100 AS seconds
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT * FROM r QUALIFY run = max(run) OVER (PARTITION BY job_id, country_iso3)),
e AS (SELECT country_iso3, job_id, max(failed::INT)::BIGINT AS failed, max(seconds) AS seconds FROM l GROUP BY ALL)
SELECT country_iso3, count(*) AS jobs, sum(failed)::BIGINT AS failed, sum(seconds)::BIGINT AS seconds, sum(failed) = 0 AS success FROM e GROUP BY country_iso3""")
def country_runs(t: Tables) -> DataFrame:
    runs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    runs = runs.select(
        F.col("o_orderpriority").alias("job_id"), F.col("n_name").alias("country_iso3"), F.date_format("o_orderdate", "yyyyMM").alias("run"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"), (F.floor("o_totalprice") % 100).alias("seconds"),
    )
    found = countries.summary(countries.latest_runs(runs))
    return found.select("country_iso3", "jobs", "failed", F.col("seconds").cast("long").alias("seconds"), "success")


_EXTRACTED = """(SELECT p_brand AS spec_id, pos, CASE WHEN p_partkey % 5 = 0 THEN 'q' || pos ELSE p_partkey::VARCHAR END AS question_id, trim(p_name) AS question
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS pos FROM part))"""


def _specs(t: Tables) -> DataFrame:
    """A specification per brand, a question per part: some without an id, some under another name, one entry in five with blanks around."""
    text = F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" "), "p_name", F.lit("\n"))).otherwise(F.col("p_name"))
    q = F.struct(
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, text).alias("question"), F.when(F.col("p_partkey") % 2 == 1, text).alias("text"),
    )
    listed = t.part.groupBy(F.col("p_brand").alias("spec_id")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", q.alias("q")))).alias("xs"))  # a specification is a row
    return listed.select("spec_id", F.to_json(F.struct(F.transform("xs", lambda x: x["q"]).alias("questions"))).alias("json"))


@query(f"SELECT * FROM {_EXTRACTED} t")
def extract_items(t: Tables) -> DataFrame:
    return extraction.extract(_specs(t), "phase1_discovery_qa")


@query(f"SELECT spec_id, count(*) AS n, string_agg(question_id, ',' ORDER BY pos) AS ids, '2024-01-02' AS generated_at FROM {_EXTRACTED} t GROUP BY spec_id")
def stub_outputs(t: Tables) -> DataFrame:
    made = stubs.stub_outputs(_specs(t), "phase1_discovery_qa", "2024-01-02", country_name="X")
    q = F.from_json(F.get_json_object("json", "$.questions"), "array<struct<question_id:string>>")
    return made.select("spec_id", F.size(q).cast("long").alias("n"), F.array_join(q["question_id"], ",").alias("ids"), F.get_json_object("json", "$.generated_at").alias("generated_at"))


@query(f"""SELECT spec_id, 'T' || chr(10) || chr(10) || '## RENDERED INPUTS (machine-generated)' AS head, string_agg(question_id || '=' || question, ';' ORDER BY pos) AS items FROM {_EXTRACTED} t GROUP BY spec_id""")
def prompt_render(t: Tables) -> DataFrame:
    p = prompts.job_prompt(_specs(t), "T \n", "phase1_discovery_qa", "X", "XYZ")
    parts = F.split("prompt", "\n", 4)
    items = F.from_json(F.get_json_object(parts[3], "$.questions"), "array<struct<question_id:string,question:string>>")
    return p.select("spec_id", F.array_join(F.slice(parts, 1, 3), "\n").alias("head"), F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["question_id"], x["question"])), ";").alias("items"))
