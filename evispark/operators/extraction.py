"""Typed items out of loosely structured JSON specifications.

A specification is a row (spec_id, json). Its top level is read as a map of JSON texts, which keeps the order of
the keys, so aliases, lists found by their looks, and fallbacks are all expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, humanise, strip

_MAP, _LIST = "map<string,string>", "array<string>"


@dataclass(frozen=True)
class Extractor:
    """Where a job's items are and what they have.

    ``lists``: keys of the list, the first that is a list wins, even empty. ``hints``: else, the first list of
    objects of which one has such a key. ``fields``: name -> aliases, of which the first that isn't empty counts.
    ``default``: prefix of ids by position. Items need every field but ``optional`` ones.
    """

    lists: tuple[str, ...]
    hints: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]
    default: str
    optional: tuple[str, ...] = field(default=())


#: Fixed: the keys under which specifications have these things.
EXTRACTORS = {
    "phase1_discovery_qa": Extractor(
        ("questions", "discovery_questions", "items"), ("question", "prompt"),
        {"question_id": ("question_id", "id", "qid"), "question": ("question", "text", "prompt", "question_text")}, "q",
    ),
    "rrr_evidence_matrix": Extractor(
        ("solutions", "rrr_solutions", "items"), ("solution", "intervention"),
        {"solution_id": ("solution_id", "id"), "solution": ("solution", "intervention", "title"), "mechanism": ("mechanism", "description", "how_it_works")}, "s", ("mechanism",),
    ),
    "table2_root_cause_mapping": Extractor(
        ("framework_items", "items", "root_causes", "table2", "rows"), ("cause", "root", "category"),
        {"item_id": ("item_id", "id"), "category": ("category", "domain", "pillar"), "root_cause": ("root_cause", "cause", "driver", "rootCause"), "definition": ("definition", "description", "details")}, "t2_",
    ),
    "table3_intervention_framework": Extractor(
        ("interventions", "items", "table3", "rows"), ("intervention", "lever", "mechanism"),
        {"intervention_id": ("intervention_id", "id"), "lever": ("lever", "domain", "category"), "intervention": ("intervention", "name", "title"), "mechanism": ("mechanism", "description", "how_it_works")}, "t3_",
    ),
    "country_learning_briefs": Extractor(
        ("domains", "learning_domains", "items"), ("domain", "learning", "label"),
        {"domain_id": ("domain_id", "id"), "domain": ("domain", "label", "name", "title")}, "ld_",
    ),
    "benchmark_country_scoring": Extractor(
        ("dimensions", "scoring_dimensions", "criteria"), ("dimension", "criteria", "label"),
        {"dimension_id": ("dimension_id", "criterion_id", "id"), "label": ("label", "name", "title")}, "d",
    ),
}
COUNTRIES = Extractor(
    ("countries", "benchmark_countries", "candidates"), ("iso3", "country", "name"),
    {"country_name": ("country_name", "name"), "iso3": ("iso3", "ISO3")}, "",
)


#: Fixed: what the stub of benchmarks reads instead: no list by its looks, and nested criteria only with an id.
STUB_DIMENSIONS = Extractor(("dimensions", "scoring_dimensions", "criteria"), (), {"dimension_id": ("dimension_id", "id"), "label": ("label", "name", "title")}, "d")
STUB_CRITERIA = Extractor((), (), {"dimension_id": ("criterion_id", "id"), "label": ("name", "label")}, "")
STUB_COUNTRIES = Extractor(COUNTRIES.lists, (), COUNTRIES.fields, "")


def _list(text: Column) -> Column:
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, _LIST))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("{")), F.lit(False))


def _no_list() -> Column:
    return F.expr("cast(array() as array<string>)")


def _candidates(top: Column, e: Extractor) -> Column:
    named = F.coalesce(_no_list()) if not e.lists else F.coalesce(*(_list(F.try_element_at(top, F.lit(k))) for k in e.lists), _no_list())
    lists = F.transform(F.map_values(top), lambda v: F.coalesce(_list(v), _no_list()))
    if not e.hints:
        return named
    has_hint = lambda x: F.size(F.array_intersect(F.coalesce(F.json_object_keys(x), _no_list()), F.array(*(F.lit(h) for h in e.hints)))) > 0
    looks = F.filter(lists, lambda v: (F.size(v) > 0) & F.forall(v, _is_object) & F.exists(v, has_hint))
    return F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.get(looks, F.lit(0)), _no_list()))


def _nested_criteria(top: Column) -> Column:
    """The criteria of all objects at the top, in order."""
    return F.flatten(F.transform(F.map_values(top), lambda v: F.when(_is_object(v), F.coalesce(_list(F.try_element_at(F.from_json(v, _MAP), F.lit("criteria"))), _no_list())).otherwise(_no_list())))


def _items(specs: DataFrame, e: Extractor, listed: Column) -> DataFrame:
    rows = specs.select("spec_id", F.posexplode(listed).alias("pos", "x")).where(_is_object(F.col("x")))
    rows = rows.select("spec_id", (F.col("pos") + 1).alias("pos"), F.from_json("x", _MAP).alias("m"))
    names = list(e.fields)
    made = {}
    for n, aliases in e.fields.items():
        values = [F.try_element_at(F.col("m"), F.lit(a)) for a in aliases]
        if n == names[0] and e.default:
            values.append(F.concat(F.lit(e.default), F.col("pos").cast("string")))
        made[n] = first_filled(*values)
    rows = rows.select("spec_id", "pos", *(v.alias(n) for n, v in made.items()))
    for n in names:
        if n not in e.optional:
            rows = rows.where(F.col(n) != "")
    return rows


def _top(specs: DataFrame) -> DataFrame:
    return specs.select("spec_id", F.from_json("json", _MAP).alias("top"))


def extract(specs: DataFrame, job_id: str) -> DataFrame:
    """(spec_id, pos, fields…) for the items of each specification, as the job reads it."""
    if job_id not in EXTRACTORS:
        raise KeyError(f"no extractor for job {job_id!r}")
    e, top = EXTRACTORS[job_id], F.col("top")
    rows = _top(specs).withColumn("c", _candidates(top, e))
    bare = F.size("c") == 0
    get = lambda k: F.coalesce(_list(F.try_element_at(top, F.lit(k))), _no_list())
    found = _items(rows, e, F.col("c"))
    if job_id == "rrr_evidence_matrix":
        seeds = rows.where(bare).select("spec_id", F.posexplode(get("intervention_families_seed_list")).alias("pos", "x")).where(strip(F.col("x")) != "")
        found = found.unionByName(seeds.select("spec_id", (F.col("pos") + 1).alias("pos"), F.concat(F.lit("int_"), (F.col("pos") + 1).cast("string")).alias("solution_id"), humanise(F.col("x")).alias("solution"), F.lit("").alias("mechanism")))
    elif job_id == "table2_root_cause_mapping":
        levels = rows.where(bare).select("spec_id", F.posexplode(get("levels")).alias("pos", "x")).where(_is_object(F.col("x")))
        m = lambda *ks: first_filled(*(F.try_element_at(F.from_json("x", _MAP), F.lit(k)) for k in ks))
        factors = F.array_join(F.from_json(F.try_element_at(F.from_json("x", _MAP), F.lit("primary_factors")), _LIST), ", ")
        levels = levels.select("spec_id", (F.col("pos") + 1).alias("pos"), m("level_id", "id").alias("item_id"), m("label", "name").alias("category"), F.coalesce(F.nullif(factors, F.lit("")), F.lit("various factors")).alias("f"))
        levels = levels.where("item_id <> '' AND category <> ''")
        root = F.concat(F.lit("Root causes at "), F.col("category"), F.lit(" level"))
        text = F.concat(F.lit("Factors affecting performance at the "), F.col("category"), F.lit(" level, including "), F.col("f"), F.lit(" (stub placeholder)"))
        found = found.unionByName(levels.select("spec_id", "pos", "item_id", "category", root.alias("root_cause"), text.alias("definition")))
    elif job_id == "table3_intervention_framework":
        goals = F.array_join(F.transform(get("objectives"), lambda o: F.replace(o, F.lit("_"), F.lit(" "))), ", ")
        cells = rows.where(bare & (F.size(get("objectives")) > 0)).select("spec_id", goals.alias("g"), F.posexplode(get("domains")).alias("pos", "x"))
        name = humanise(strip(F.col("x")))
        found = found.unionByName(cells.select(
            "spec_id", (F.col("pos") + 1).alias("pos"), F.concat(F.lit("int_"), (F.col("pos") + 1).cast("string")).alias("intervention_id"), name.alias("lever"),
            F.concat(name, F.lit(" interventions")).alias("intervention"),
            F.concat(F.lit("Interventions in the "), name, F.lit(" domain targeting: "), F.col("g")).alias("mechanism"),
        ))
    elif job_id == "benchmark_country_scoring":
        nested = _nested_criteria(top)
        found = _items(rows, e, F.when(bare, nested).otherwise(F.col("c")))
        found = _or_placeholder(specs, found, {"dimension_id": "d1", "label": "placeholder_dimension"})
    return found


def extract_countries(specs: DataFrame) -> DataFrame:
    """(spec_id, pos, country_name, iso3): the entities to score; a placeholder where a specification has none."""
    found = _items(_top(specs).withColumn("c", _candidates(F.col("top"), COUNTRIES)), COUNTRIES, F.col("c"))
    return _or_placeholder(specs, found.withColumn("iso3", F.upper("iso3")), {"country_name": "placeholder_country", "iso3": "XXX"})


def stub_benchmark(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dimensions, countries) as the stub of benchmarks reads them."""
    top = F.col("top")
    listed = _top(specs).withColumn("c", _candidates(top, STUB_DIMENSIONS))
    dims = _items(listed, STUB_DIMENSIONS, F.col("c"))
    bare = _top(specs).join(dims.select("spec_id").distinct(), "spec_id", "left_anti")
    dims = dims.unionByName(_items(bare.withColumn("c", _nested_criteria(top)), STUB_CRITERIA, F.col("c")))
    who = _items(_top(specs).withColumn("c", _candidates(top, STUB_COUNTRIES)), STUB_COUNTRIES, F.col("c")).withColumn("iso3", F.upper("iso3"))
    return (
        _or_placeholder(specs, dims, {"dimension_id": "d1", "label": "placeholder_dimension"}),
        _or_placeholder(specs, who, {"country_name": "placeholder_country", "iso3": "XXX"}),
    )


def _or_placeholder(specs: DataFrame, found: DataFrame, values: dict[str, str]) -> DataFrame:
    none = specs.select("spec_id").join(found.select("spec_id").distinct(), "spec_id", "left_anti")
    return found.unionByName(none.select("spec_id", F.lit(1).alias("pos"), *(F.lit(v).alias(k) for k, v in values.items())))


def require_items(items: DataFrame, job_id: str) -> DataFrame:
    """``items``, or an error if there is none (benchmarks have placeholders and never raise)."""
    if job_id != "benchmark_country_scoring" and not items.take(1):
        raise ValueError(f"no items for job {job_id!r} in the specification")
    return items
