"""Outputs as markdown, and as the flat tables that spreadsheets have."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, unix_lines
from ..sources import office

_CITATION = "struct<source_title:string,locator:string,source_id:string,source_type:string,source_url:string,reference:string,authors:string,doi:string,isbn:string,publisher:string,published_date:string,quote:string>"
_EVIDENCE = f"struct<quality:string,rationale:string,citations:array<{_CITATION}>>"
_SCORE = f"struct<score:string,evidence:{_EVIDENCE}>"
_HEAD = "job_id:string,spec_id:string,generated_at:string,country:struct<name:string,iso3:string>"
#: Fixed: the shape of each job's output.
PAYLOADS = {
    "phase1_discovery_qa": f"struct<{_HEAD},questions:array<struct<question_id:string,question:string,answer:string,evidence:{_EVIDENCE},tags:array<string>,notes:string>>>",
    "rrr_evidence_matrix": f"struct<{_HEAD},solutions:array<struct<solution_id:string,solution:string,mechanism:string,feasibility_resource_constrained:string,evidence:{_EVIDENCE},risks:array<string>,implementation_notes:string>>>",
    "table2_root_cause_mapping": f"struct<{_HEAD},framework_items:array<struct<item_id:string,category:string,root_cause:string,definition:string,evidence:{_EVIDENCE},tags:array<string>>>>",
    "table3_intervention_framework": f"struct<{_HEAD},interventions:array<struct<intervention_id:string,lever:string,intervention:string,mechanism:string,implementation_notes:string,dependencies:array<string>,risks:array<string>,evidence:{_EVIDENCE}>>>",
    "benchmark_country_scoring": f"struct<{_HEAD},countries:array<struct<country_name:string,iso3:string,overall_score:{_SCORE},dimensions:array<struct<dimension_id:string,label:string,score_note:{_SCORE}>>>>>",
    "country_learning_briefs": f"struct<{_HEAD},domains:array<struct<domain_id:string,domain:string,summary:string,key_questions:array<string>,evidence:{_EVIDENCE}>>>",
}


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _line(x: Column) -> Column:
    return unix_lines(_s(x))


def citation_lines(citations: Column) -> Column:
    """A numbered list under a heading; '' without citations."""

    def one(c: Column, i: Column) -> Column:
        dash = lambda x: F.concat(F.lit("— "), _filled(x))
        head = F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(c["source_title"], F.lit("Unknown source")))
        date = F.concat(F.lit("("), _filled(c["published_date"]), F.lit(")"))
        line = F.concat_ws(" ", head, date, dash(c["locator"]), dash(c["source_url"]))
        return F.concat_ws("\n", line, F.concat(F.lit("   - _Quote_: "), _filled(c["quote"])))

    return F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, F.concat(F.lit("**Citations**:\n"), F.array_join(F.transform(citations, one), "\n"))).otherwise("")


def flat_citations(citations: Column) -> Column:
    """``title | locator | address`` by lines, without what is empty."""
    bits = F.transform(citations, lambda c: F.concat_ws(" | ", _filled(c["source_title"]), _filled(c["locator"]), _filled(c["source_url"])))
    return _s(F.array_join(F.filter(bits, lambda b: b != ""), "\n"))


def joined(x: Column) -> Column:
    return _s(F.array_join(x, "; "))


def _evidence(e: Column) -> Column:
    return F.concat(
        F.lit("**Evidence quality:** "), _s(e["quality"]), F.lit("\n\n**Rationale:** "), _line(e["rationale"]), F.lit("\n\n"), citation_lines(e["citations"]), F.lit("\n\n")
    )


def _labelled(name: str, x: Column) -> Column:
    """A paragraph ``**name:** x`` that is left out if x is empty."""
    return _s(F.concat(F.lit(f"**{name}:** "), _filled(x), F.lit("\n\n")))


def _section(head: Column, *rest: Column) -> Column:
    return F.concat(F.lit("### "), head, *rest)


def _qa(q: Column) -> Column:
    return _section(_s(q["question_id"]), F.lit("\n**Q:** "), _line(q["question"]), F.lit("\n\n**A:** "), _line(q["answer"]), F.lit("\n\n"), _evidence(q["evidence"]))


def _solution(s: Column) -> Column:
    return _section(
        F.concat(_s(s["solution_id"]), F.lit(": "), _line(s["solution"])), F.lit("\n\n**Mechanism:** "), _line(s["mechanism"]),
        F.lit("\n\n**Feasibility (resource-constrained):** "), _s(s["feasibility_resource_constrained"]), F.lit("\n\n"),
        _labelled("Risks", joined(s["risks"])), _labelled("Implementation notes", unix_lines(s["implementation_notes"])), _evidence(s["evidence"]),
    )


def _framework(i: Column) -> Column:
    return _section(
        F.concat(_s(i["item_id"]), F.lit(": "), _line(i["root_cause"])), F.lit("\n\n- **Category:** "), _line(i["category"]),
        F.lit("\n- **Definition:** "), _line(i["definition"]), F.lit("\n\n"), _evidence(i["evidence"]),
    )


def _intervention(i: Column) -> Column:
    return _section(
        F.concat(_s(i["intervention_id"]), F.lit(": "), _line(i["intervention"])), F.lit("\n\n- **Lever:** "), _line(i["lever"]),
        F.lit("\n- **Mechanism:** "), _line(i["mechanism"]), F.lit("\n\n"), _labelled("Dependencies", joined(i["dependencies"])),
        _labelled("Risks", joined(i["risks"])), _labelled("Implementation notes", unix_lines(i["implementation_notes"])), _evidence(i["evidence"]),
    )


def _country(c: Column) -> Column:
    def dimension(d: Column) -> Column:
        n = d["score_note"]
        return F.concat(
            F.lit("- **"), _line(d["label"]), F.lit("** ("), _s(d["dimension_id"]), F.lit("): "), _s(n["score"]), F.lit("\n  - quality: "), _s(n["evidence"]["quality"]),
            F.lit("\n  - rationale: "), _line(n["evidence"]["rationale"]), F.lit("\n"),
        )

    o = c["overall_score"]
    return _section(
        F.concat(_line(c["country_name"]), F.lit(" ("), _s(c["iso3"]), F.lit(")")), F.lit("\n\n**Overall score:** "), _s(o["score"]), F.lit("\n\n"), _evidence(o["evidence"]),
        F.lit("#### Dimensions\n\n"), _s(F.array_join(F.transform(c["dimensions"], dimension), "")), F.lit("\n"),
    )


def _domain(d: Column) -> Column:
    asked = F.array_join(F.transform(d["key_questions"], lambda q: F.concat(F.lit("- "), _line(q), F.lit("\n"))), "")
    return _section(
        F.concat(_s(d["domain_id"]), F.lit(": "), _line(d["domain"])), F.lit("\n\n**Summary:** "), _line(d["summary"]), F.lit("\n\n**Key questions:**\n"), _s(asked), F.lit("\n"), _evidence(d["evidence"])
    )


_LAYOUTS = {
    "phase1_discovery_qa": ("## Questions\n", "questions", _qa),
    "rrr_evidence_matrix": ("## Solutions\n\n", "solutions", _solution),
    "table2_root_cause_mapping": ("## Framework items\n\n", "framework_items", _framework),
    "table3_intervention_framework": ("## Interventions\n\n", "interventions", _intervention),
    "benchmark_country_scoring": ("## Countries\n\n", "countries", _country),
    "country_learning_briefs": ("## Learning domains\n\n", "domains", _domain),
}


def parse_output(json: Column, job_id: str) -> Column:
    if job_id not in PAYLOADS:
        raise KeyError(f"unsupported job {job_id!r}")
    return F.from_json(json, PAYLOADS[job_id])


def markdown(outputs: DataFrame, job_id: str, json: str = "json") -> DataFrame:
    """``outputs`` with ``markdown``: the job's layout of each output."""
    rows = outputs.withColumn("__p", parse_output(F.col(json), job_id))
    p = F.col("__p")
    meta = lambda k, v: F.concat(F.lit(f"- **{k}**: "), v)
    iso = _s(F.concat(F.lit(" ("), _filled(p["country"]["iso3"]), F.lit(")")))
    lines = F.concat_ws("\n", meta("spec_id", _filled(p["spec_id"])), meta("generated_at", _filled(p["generated_at"])), meta("country", F.concat(_filled(p["country"]["name"]), iso)))
    heading, key, section = _LAYOUTS[job_id]
    body = _s(F.array_join(F.transform(p[key], section), ""))
    text = F.concat(F.lit(f"# {job_id}\n"), F.when(lines != "", F.concat(lines, F.lit("\n\n"))).otherwise("\n"), F.lit(heading), body)
    return rows.withColumn("markdown", F.concat(strip(text), F.lit("\n"))).drop("__p")


#: Fixed: the columns of each flat table, as (name, path) with how a path's value is written.
_EV = (("evidence_quality", "evidence.quality"), ("evidence_rationale", "evidence.rationale"), ("citations", "evidence.citations"))
FLAT = {
    "rrr_evidence_matrix": ("solutions", (*((c, c) for c in ("solution_id", "solution", "mechanism", "feasibility_resource_constrained")), *_EV, ("risks", "risks"), ("implementation_notes", "implementation_notes"))),
    "table2_root_cause_mapping": ("framework_items", (*((c, c) for c in ("item_id", "category", "root_cause", "definition")), *_EV, ("tags", "tags"))),
    "table3_intervention_framework": ("interventions", (*((c, c) for c in ("intervention_id", "lever", "intervention", "mechanism", "implementation_notes", "dependencies", "risks")), *_EV)),
}
NARRATIVE = ("phase1_discovery_qa", "country_learning_briefs")
_TOLD = {"phase1_discovery_qa": ("questions", "question", "answer"), "country_learning_briefs": ("domains", "domain", "summary")}


def _cell(x: Column, name: str) -> Column:
    if name.endswith("citations"):
        return flat_citations(x)
    return joined(x) if name in ("risks", "tags", "dependencies") else _s(x)


def flat_tables(outputs: DataFrame, job_id: str, json: str = "json") -> dict[str, DataFrame]:
    """The sheets of a job's output: ``data``, or ``countries`` and ``dimensions`` for benchmarks. Narrative jobs have none."""
    rows = outputs.select(parse_output(F.col(json), job_id).alias("p"))
    if job_id in FLAT:
        key, columns = FLAT[job_id]
        x = rows.select(F.explode(f"p.{key}").alias("x"))
        return {"data": x.select(*(_cell(F.col(f"x.{path}"), n).alias(n) for n, path in columns))}
    if job_id != "benchmark_country_scoring":
        raise KeyError(f"no flat table for job {job_id!r}")
    c = rows.select(F.explode("p.countries").alias("c"))
    d = c.select("c", F.explode("c.dimensions").alias("d"))
    return {"countries": c.select(*_country_cells(F.col("c"))), "dimensions": d.select(*_dimension_cells(F.col("c"), F.col("d")))}


def _score_cells(x: Column, before: str) -> list[Column]:
    e = x["evidence"]
    return [
        _s(x["score"]).alias(f"{before}score"), _s(e["quality"]).alias(f"{before}quality"), _s(e["rationale"]).alias(f"{before}rationale"),
        flat_citations(e["citations"]).alias(f"{before}citations"),
    ]


def _country_cells(c: Column) -> list[Column]:
    return [_s(c["country_name"]).alias("country_name"), _s(c["iso3"]).alias("iso3"), *_score_cells(c["overall_score"], "overall_")]


def _dimension_cells(c: Column, d: Column) -> list[Column]:
    named = [_s(d["dimension_id"]).alias("dimension_id"), _s(d["label"]).alias("label")]
    return [*_country_cells(c)[:2], *named, *_score_cells(d["score_note"], "")]


#: Fixed: the headings of the two sheets of benchmarks.
_SCORES = ("score", "quality", "rationale", "citations")
COUNTRY_SHEETS = {"countries": ("country_name", "iso3", *(f"overall_{c}" for c in _SCORES)), "dimensions": ("country_name", "iso3", "dimension_id", "label", *_SCORES)}


def sheets(outputs: DataFrame, job_id: str, json: str = "json") -> DataFrame:
    """``outputs`` with ``sheets``, an array of (name, rows), the first row the headings: ``flat_tables`` of each output in its row.

    What has no items gives a sheet of headings only. Jobs without flat tables are a KeyError.
    """
    rows = outputs.withColumn("__p", parse_output(F.col(json), job_id))
    p, nothing = F.col("__p"), F.expr("cast(array() as array<array<string>>)")
    sheet = lambda name, head, body: F.struct(F.lit(name).alias("name"), F.concat(F.array(F.array(*map(F.lit, head))), F.coalesce(body, nothing)).alias("rows"))
    if job_id in FLAT:
        key, columns = FLAT[job_id]
        at = lambda x, path: x[path] if "." not in path else x[path.split(".")[0]][path.split(".")[1]]
        body = F.transform(p[key], lambda x: F.array(*(_cell(at(x, path), n) for n, path in columns)))
        made = [sheet("data", [n for n, _ in columns], body)]
    elif job_id == "benchmark_country_scoring":
        each = F.transform(p["countries"], lambda c: F.coalesce(F.transform(c["dimensions"], lambda d: F.array(*_dimension_cells(c, d))), nothing))
        body = {"countries": F.transform(p["countries"], lambda c: F.array(*_country_cells(c))), "dimensions": F.flatten(each)}
        made = [sheet(n, head, body[n]) for n, head in COUNTRY_SHEETS.items()]
    else:
        raise KeyError(f"no flat table for job {job_id!r}")
    return rows.withColumn("sheets", F.array(*made)).drop("__p")


def narrative(outputs: DataFrame, job_id: str, json: str = "json") -> DataFrame:
    """``outputs`` with ``paragraphs``, an array of (style, text): what a document says of each output, under the job's name."""
    if job_id not in NARRATIVE:
        raise KeyError(f"no document layout for job {job_id!r}")
    key, head, body = _TOLD[job_id]
    said = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"))

    def one(x: Column) -> Column:
        e = x["evidence"]
        cited = citation_lines(e["citations"])
        told = [
            said("Heading1", _s(x[head])), said("Normal", _s(x[body])), said("Normal", F.concat(F.lit("Evidence quality: "), _s(e["quality"]))),
            said("Normal", F.concat(F.lit("Rationale: "), _s(e["rationale"]))), said("Normal", cited),
        ]
        return F.when(cited == "", F.array(*told[:4])).otherwise(F.array(*told))

    rows = outputs.withColumn("__p", parse_output(F.col(json), job_id))
    told = F.flatten(F.transform(F.col("__p")[key], one))
    title = F.array(said("Title", F.lit(job_id)))
    return rows.withColumn("paragraphs", F.when(told.isNull(), title).otherwise(F.concat(title, told))).drop("__p")


def files(outputs: DataFrame, job_id: str, form: str, name: str = "name", json: str = "json") -> DataFrame:
    """(name, content): a workbook (``xlsx``), a document (``docx``) or markdown text (``md``) of each output, made in its task.

    Column ``name`` tells the name without an ending. Widths of a workbook's columns are those of ``column_widths``.
    """
    named = F.concat(F.col(name), F.lit(f".{form}")).alias("name")
    if form == "md":
        return markdown(outputs, job_id, json).select(named, F.encode("markdown", "UTF-8").alias("content"))
    if form not in ("xlsx", "docx"):
        raise ValueError(f"no form {form!r}")
    made = sheets(outputs, job_id, json).select(named, F.col("sheets").alias("x")) if form == "xlsx" else narrative(outputs, job_id, json).select(named, F.col("paragraphs").alias("x"))

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [_workbook(x) if form == "xlsx" else office.docx([(p["style"], p["text"]) for p in x]) for x in batch["x"]]})

    return made.mapInPandas(built, "name string, content binary")


def _workbook(sheets: list[dict]) -> bytes:
    tables = {s["name"]: [list(r) for r in s["rows"]] for s in sheets}
    widths = {n: [min(max(12, max(len(r[c]) for r in rows) + 2), 60) for c in range(len(rows[0]))] for n, rows in tables.items()}
    return office.xlsx({n: (rows[0], [tuple(r) for r in rows[1:]]) for n, rows in tables.items()}, widths)


def narrative_rows(outputs: DataFrame, job_id: str, json: str = "json") -> DataFrame:
    """(pos, heading, body lines…) of the two narrative jobs, for a document writer."""
    if job_id not in NARRATIVE:
        raise KeyError(f"no document layout for job {job_id!r}")
    key, head, body = _TOLD[job_id]
    x = outputs.select(F.posexplode(parse_output(F.col(json), job_id)[key]).alias("pos", "x"))
    return x.select("pos", F.col(f"x.{head}").alias("heading"), F.col(f"x.{body}").alias("body"), "x.evidence.quality", "x.evidence.rationale", citation_lines(F.col("x.evidence.citations")).alias("citations"))


def column_widths(df: DataFrame, columns: list[str], least: int = 12, most: int = 60) -> DataFrame:
    """(column, width): the longest value plus 2, the heading counted, between the limits. One aggregate row."""
    longest = df.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns))
    width = lambda c: F.least(F.greatest(F.lit(least), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))) + 2), F.lit(most))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), width(c).alias("width")) for c in columns))
    return longest.select(F.inline(cells))
