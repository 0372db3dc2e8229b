"""Deterministic placeholder outputs: what a job gives when nothing was searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extraction

#: Fixed texts of stub outputs.
RATIONALE = "Stub run: no sources were provided or searched."
ANSWER = "TBD (stub)."


def no_evidence() -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.lit("none").alias("quality"), F.lit(RATIONALE).alias("rationale"), none.alias("citations"))


def _empty() -> Column:
    return F.expr("cast(array() as array<string>)")


def _item(job_id: str) -> Column:
    c = F.col
    if job_id == "phase1_discovery_qa":
        return F.struct("question_id", "question", F.lit(ANSWER).alias("answer"), no_evidence().alias("evidence"), _empty().alias("tags"))
    if job_id == "rrr_evidence_matrix":
        m = F.coalesce(F.nullif(c("mechanism"), F.lit("")), F.concat(F.lit("To be determined from evidence for "), c("solution")))
        return F.struct(
            "solution_id", "solution", m.alias("mechanism"), no_evidence().alias("evidence"), F.lit("unknown").alias("feasibility_resource_constrained"),
            _empty().alias("risks"), F.lit("").alias("implementation_notes"),
        )
    if job_id == "table2_root_cause_mapping":
        return F.struct("item_id", "category", "root_cause", "definition", no_evidence().alias("evidence"), _empty().alias("tags"))
    if job_id == "table3_intervention_framework":
        return F.struct(
            "intervention_id", "lever", "intervention", "mechanism", no_evidence().alias("evidence"), F.lit("").alias("implementation_notes"),
            _empty().alias("dependencies"), _empty().alias("risks"),
        )
    return F.struct("domain_id", "domain", F.lit("TBD (stub).").alias("summary"), F.array(F.lit("TBD (stub).")).alias("key_questions"), no_evidence().alias("evidence"))


_KEYS = {
    "phase1_discovery_qa": "questions", "rrr_evidence_matrix": "solutions", "table2_root_cause_mapping": "framework_items",
    "table3_intervention_framework": "interventions", "country_learning_briefs": "domains",
}


def stub_outputs(specs: DataFrame, job_id: str, generated_at: str, country_name: str | None = None, country_iso3: str | None = None) -> DataFrame:
    """(spec_id, json): one output per specification. The date is an argument, so runs repeat."""
    if job_id == "benchmark_country_scoring":
        rows, who = extraction.stub_benchmark(specs)
        score = F.struct(F.lit(0).alias("score"), no_evidence().alias("evidence"))
        dims = rows.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "dimension_id", "label"))).alias("d"))
        dims = dims.select("spec_id", F.transform("d", lambda d: F.struct(d["dimension_id"].alias("dimension_id"), d["label"].alias("label"), score.alias("score_note"))).alias("dimensions"))
        who = who.join(dims, "spec_id")
        item, key, rows = F.struct("country_name", "iso3", score.alias("overall_score"), "dimensions"), "countries", who
    else:
        item, key, rows = _item(job_id), _KEYS[job_id], extraction.extract(specs, job_id)
    grouped = rows.select("spec_id", F.struct("pos", item.alias("v")).alias("x")).groupBy("spec_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    country = F.struct(F.lit(country_name).alias("name"), F.lit(country_iso3).alias("iso3"))
    head = [F.lit(job_id).alias("job_id"), "spec_id", F.lit(generated_at).alias("generated_at")]
    if country_name and job_id in ("phase1_discovery_qa", "country_learning_briefs"):
        head.append(country.alias("country"))
    return grouped.select("spec_id", F.to_json(F.struct(*head, F.transform("xs", lambda x: x["v"]).alias(key))).alias("json"))
