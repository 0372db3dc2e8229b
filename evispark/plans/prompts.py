"""Prompts: a template and its inputs as JSON, with or without retrieved sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, retrieval, selection

#: Fixed texts that follow a template.
INPUTS = "\n\n## RENDERED INPUTS (machine-generated)\n"
SOURCE_IDS = (
    "\n## IMPORTANT: Source ID Enforcement\n"
    "When citing from the allowed_sources above, you MUST include the source_id field in each citation.\n"
    "The source_id must match one of the source_id values from allowed_sources (e.g., SRC1, SRC2, etc.).\n"
    "This enables validation that citations reference only the curated sources provided.\n"
)
#: Fixed: under which name a job's items go into its prompt; and the jobs that need a country.
INPUT_KEYS = {
    "phase1_discovery_qa": "questions", "rrr_evidence_matrix": "solutions", "table2_root_cause_mapping": "framework_items",
    "table3_intervention_framework": "interventions", "benchmark_country_scoring": "dimensions", "country_learning_briefs": "learning_domains",
}
NEEDS_COUNTRY = ("phase1_discovery_qa", "country_learning_briefs")


def assemble(template: Column, inputs: Column, has_sources: Column | None = None) -> Column:
    """Template, heading, inputs as indented JSON, and the rule about source ids where there are sources."""
    text = F.concat(F.regexp_replace(template, r"\s+$", ""), F.lit(INPUTS), F.to_json(inputs, {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n"))
    return text if has_sources is None else F.concat(text, F.when(has_sources, F.lit(SOURCE_IDS)).otherwise(""))


def _items(specs: DataFrame, job_id: str) -> DataFrame:
    rows = extraction.extract(specs, job_id)
    fields = [c for c in rows.columns if c not in ("spec_id", "pos")]
    grouped = rows.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("v")))).alias("xs"))
    return grouped.select("spec_id", F.transform("xs", lambda x: x["v"]).alias("items"))


def job_prompt(
    specs: DataFrame, template: str, job_id: str, country_name: str | None = None, country_iso3: str | None = None,
    sources: DataFrame | None = None, max_snippet_chars: int = selection.BUDGET, batch: str | None = None,
) -> DataFrame:
    """(spec_id, prompt). ``sources`` (source_id, source_title, pos, snippets) are cut to the budget first.

    With ``batch``, a column of ``sources``, each of its values makes a prompt: (spec_id, batch, prompt).
    """
    if job_id in NEEDS_COUNTRY and not country_name:
        raise ValueError(f"job {job_id!r} needs a country")
    if job_id not in INPUT_KEYS:
        raise KeyError(f"unsupported job {job_id!r}")
    rows, by = _items(specs, job_id), [batch] if batch else []
    inputs = [F.col("spec_id")]
    if sources is not None:
        kept = selection.trim_sources(sources, max_snippet_chars, by)
        each = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("source_id", "source_title", "snippets").alias("v")))).alias("s"))
        each = each.select(*by, F.transform("s", lambda x: x["v"]).alias("allowed"))
        rows = rows.crossJoin(each if by else F.broadcast(each))  # without batches one row, within the budget
        inputs.append(F.col("allowed").alias("allowed_sources"))
    if job_id in NEEDS_COUNTRY:
        inputs += [F.lit(country_name).alias("country_name"), F.lit(country_iso3).cast("string").alias("country_iso3")]
    inputs.append(F.col("items").alias(INPUT_KEYS[job_id]))
    if job_id == "benchmark_country_scoring":
        who = extraction.extract_countries(specs).groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("pos", "country_name", "iso3"))).alias("w"))
        rows = rows.join(who.select("spec_id", F.transform("w", lambda x: F.struct(x["country_name"].alias("country_name"), x["iso3"].alias("iso3"))).alias("countries")), "spec_id")
        inputs.append(F.col("countries"))
    has = F.size("allowed") > 0 if sources is not None else None
    return rows.select("spec_id", *by, assemble(F.lit(template), F.struct(*inputs), has).alias("prompt"))


def rag_queries(specs: DataFrame, job_id: str) -> DataFrame:
    """(spec_id, pos, query): what is searched for each item; benchmarks are one query over all labels."""
    rows = extraction.extract(specs, job_id)
    c = F.col
    if job_id == "benchmark_country_scoring":
        labels = rows.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"))
        return labels.select("spec_id", F.lit(1).alias("pos"), selection.benchmark_query(F.transform("l", lambda x: x["label"])).alias("query"))
    query = {
        "phase1_discovery_qa": lambda: c("question"),
        "rrr_evidence_matrix": lambda: selection.solution_query(c("solution"), c("mechanism")),
        "table2_root_cause_mapping": lambda: selection.item_query(c("category"), c("root_cause"), c("definition")),
        "table3_intervention_framework": lambda: selection.item_query(c("lever"), c("intervention"), c("mechanism")),
        "country_learning_briefs": lambda: selection.domain_query(c("domain")),
    }[job_id]()
    return rows.select("spec_id", "pos", query.alias("query"))


def rag_prompts(queries: DataFrame, index: DataFrame, template: str, k: int = 40) -> DataFrame:
    """(query_id, prompt): each query (query_id, query vector, inputs struct) with its k best snippets, regrouped by source."""
    hits = retrieval.top_k_per_query(index, queries.select("query_id", "query"), k)
    by_source = retrieval.group_by_source(hits, ["query_id"])
    source = F.struct("first", F.struct("source_id", "source_title", "snippets").alias("v"))
    allowed = by_source.groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("a"))
    allowed = allowed.select("query_id", F.transform("a", lambda x: x["v"]).alias("allowed_sources"))
    rows = queries.drop("query").join(allowed, "query_id", "left")
    return rows.select("query_id", assemble(F.lit(template), F.struct("allowed_sources", "inputs"), F.coalesce(F.size("allowed_sources"), F.lit(0)) > 0).alias("prompt"))
