"""Extraction for every job: a specification per brand, an entry per part, in the forms that specifications take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extraction
from .base import Registered, Tables

query = Registered()
QUERIES, ORACLE_SQL = query.queries, query.oracles

_P = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY i)::INTEGER AS pos, row_number() OVER (PARTITION BY spec_id ORDER BY i % 2, i)::INTEGER AS npos
 FROM (SELECT p_brand AS spec_id, substr(p_brand, 7)::INTEGER AS k, p_partkey AS i, p_name AS a, p_type AS b, 'w' || p_size AS c FROM part)),
s AS (SELECT DISTINCT spec_id, k FROM p), l AS (SELECT * FROM p WHERE k % 4 <> 2 AND NOT (k % 4 = 0 AND i % 7 = 0)) """
_TITLE = "array_to_string(list_transform(string_split(a, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _id(default: str, pos: str = "pos") -> str:
    return f"CASE WHEN i % 5 = 0 THEN '{default}' || {pos} ELSE i::VARCHAR END"


def _joined(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(xs, ", "), F.lit("]"))


def _loose(t: Tables, e: extraction.Extractor, values: dict[str, Column], fallback: Callable[[Column], Column] | None = None) -> DataFrame:
    """(spec_id, json). The brand's number modulo 4 tells the form: 0 a list under its second name, with entries that
    are no objects; 1 a list under an unknown name, behind lists that don't look like it; 2 no list, only what
    ``fallback`` makes of the entries; 3 a list under its first name that is empty, and the entries under the second.
    Entries take the names of their fields in turn; one id in five is missing, one of the last field in eleven.
    """
    part = t.part.select(F.col("p_brand").alias("spec_id"), F.substr("p_brand", F.lit(7)).cast("int").alias("k"), F.col("p_partkey").alias("i"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.concat(F.lit("w"), F.col("p_size").cast("string")).alias("c"))
    part = part.withColumn("pos", F.row_number().over(Window.partitionBy("spec_id").orderBy("i")))  # a specification is a row
    last = list(e.fields)[-1]
    said = {n: F.when(F.col("i") % 11 != 0, v) if n == last else v for n, v in values.items()}
    entry = F.to_json(F.struct(*(F.when((F.col("pos") - 1) % len(names) == j, said[n]).alias(name) for n, names in e.fields.items() for j, name in enumerate(names))))
    entry = F.when((F.col("k") % 4 == 0) & (F.col("i") % 7 == 0), F.lit('"no object"')).otherwise(entry)
    xs = part.groupBy("spec_id", "k").agg(F.sort_array(F.collect_list(F.struct("i", "pos", entry.alias("entry"), "a", "b"))).alias("xs"))
    listed, form = _joined(F.col("xs")["entry"]), F.col("k") % 4
    first, second = e.lists[:2]
    json = (
        F.when(form == 0, F.concat(F.lit(f'{{"note": "n", "{second}": '), listed, F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"z": ["x"], "y": [{"other": 1}], "x": '), listed, F.lit(', "w": [{"question": "later"}]}')))
        .when(form == 3, F.concat(F.lit(f'{{"{second}": '), listed, F.lit(f', "{first}": []}}')))
        .otherwise(fallback(F.col("xs")) if fallback else F.lit('{"note": {"criteria": "none"}}'))
    )
    return xs.select("spec_id", json.alias("json"))


def _some_ids() -> Column:
    return F.when(F.col("i") % 5 != 0, F.col("i").cast("string"))


def _names() -> Column:
    """Names, one in five with white space around it."""
    return F.when(F.col("i") % 5 == 1, F.concat(F.lit(" "), F.col("a"), F.lit("\n"))).otherwise(F.col("a"))


_SNAKE = lambda x: F.to_json(F.array(F.replace(x["a"], F.lit(" "), F.lit("_"))))


def _flat(xs: Column, one: Callable[[Column], Column]) -> Column:
    """A JSON list of strings that ``one`` makes, each as a list of one."""
    return _joined(F.transform(xs, lambda x: F.substr(one(x), F.lit(2), F.length(one(x)) - 2)))


@query(f"""{_P} SELECT spec_id, pos, {_id('s')} AS solution_id, a AS solution, CASE WHEN i % 11 = 0 THEN '' ELSE b END AS mechanism FROM l
UNION ALL SELECT spec_id, pos, 'int_' || pos, {_TITLE}, '' FROM p WHERE k % 4 = 2 AND i % 7 <> 0""")
def extract_solutions(t: Tables) -> DataFrame:
    seeds = lambda xs: F.concat(F.lit('{"intervention_families_seed_list": '), _flat(xs, lambda x: F.when(x["i"] % 7 == 0, '[" "]').otherwise(_SNAKE(x))), F.lit("}"))
    e = extraction.EXTRACTORS["rrr_evidence_matrix"]
    return extraction.extract(_loose(t, e, {"solution_id": _some_ids(), "solution": _names(), "mechanism": F.col("b")}, seeds), "rrr_evidence_matrix")


@query(f"""{_P} SELECT spec_id, pos, {_id('t2_')} AS item_id, a AS category, b AS root_cause, c AS definition FROM l WHERE i % 11 <> 0
UNION ALL SELECT spec_id, pos, i::VARCHAR, a, 'Root causes at ' || a || ' level',
 'Factors affecting performance at the ' || a || ' level, including ' || CASE WHEN i % 3 = 0 THEN 'various factors' ELSE b || ', k' || i END || ' (stub placeholder)' FROM p WHERE k % 4 = 2 AND i % 5 <> 0""")
def extract_root_causes(t: Tables) -> DataFrame:
    def levels(xs: Column) -> Column:
        i = lambda x: F.when(x["i"] % 5 != 0, x["i"].cast("string"))
        factors = lambda x: F.when(x["i"] % 3 != 0, F.array(x["b"], F.concat(F.lit("k"), x["i"].cast("string"))))
        one = lambda x: F.to_json(F.struct(F.when(x["pos"] % 2 == 0, i(x)).alias("id"), F.when(x["pos"] % 2 == 1, i(x)).alias("level_id"), x["a"].alias("name"), factors(x).alias("primary_factors")))
        return F.concat(F.lit('{"levels": '), _joined(F.transform(xs, one)), F.lit("}"))

    e = extraction.EXTRACTORS["table2_root_cause_mapping"]
    return extraction.extract(_loose(t, e, {"item_id": _some_ids(), "category": _names(), "root_cause": F.col("b"), "definition": F.col("c")}, levels), "table2_root_cause_mapping")


@query(f"""{_P} SELECT spec_id, pos, {_id('t3_')} AS intervention_id, a AS lever, b AS intervention, c AS mechanism FROM l WHERE i % 11 <> 0
UNION ALL SELECT spec_id, pos, 'int_' || pos, {_TITLE}, {_TITLE} || ' interventions', 'Interventions in the ' || {_TITLE} || ' domain targeting: cut cost, reach ' || k FROM p WHERE k % 4 = 2 AND k % 8 = 2""")
def extract_interventions(t: Tables) -> DataFrame:
    goals = F.concat(F.lit(', "objectives": ["cut_cost", "reach_'), F.col("k").cast("string"), F.lit('"]'))
    cells = lambda xs: F.concat(F.lit('{"domains": '), _flat(xs, _SNAKE), F.when(F.col("k") % 8 == 2, goals).otherwise(""), F.lit("}"))
    e = extraction.EXTRACTORS["table3_intervention_framework"]
    return extraction.extract(_loose(t, e, {"intervention_id": _some_ids(), "lever": _names(), "intervention": F.col("b"), "mechanism": F.col("c")}, cells), "table3_intervention_framework")


@query(f"{_P} SELECT spec_id, pos, {_id('ld_')} AS domain_id, a AS domain FROM l WHERE i % 11 <> 0")
def extract_domains(t: Tables) -> DataFrame:
    e = extraction.EXTRACTORS["country_learning_briefs"]
    return extraction.extract(_loose(t, e, {"domain_id": _some_ids(), "domain": _names()}), "country_learning_briefs")


def _benchmarks(t: Tables) -> DataFrame:
    """Without a list, criteria of even entries under a name that sorts behind that of the odd ones; a quarter of those brands has none."""

    def phases(xs: Column) -> Column:
        half = lambda odd: _joined(F.transform(F.filter(xs, lambda x: x["i"] % 2 == odd), lambda x: x["entry"]))
        some = F.concat(F.lit('{"phase2": {"criteria": '), half(0), F.lit('}, "note": ["n"], "phase1": {"criteria": '), half(1), F.lit("}}"))
        return F.when(F.col("k") % 8 == 2, some).otherwise("{}")

    return _loose(t, extraction.EXTRACTORS["benchmark_country_scoring"], {"dimension_id": _some_ids(), "label": _names()}, phases)


_NONE = "SELECT spec_id, 1, 'd1', 'placeholder_dimension' FROM s WHERE spec_id NOT IN (SELECT spec_id FROM f)"


@query(f"""{_P}, f AS (SELECT spec_id, pos, {_id('d')} AS dimension_id, a AS label FROM l WHERE i % 11 <> 0
 UNION ALL SELECT spec_id, npos, {_id('d', 'npos')}, a FROM p WHERE k % 8 = 2 AND i % 11 <> 0) SELECT * FROM f UNION ALL {_NONE}""")
def extract_dimensions(t: Tables) -> DataFrame:
    return extraction.extract(_benchmarks(t), "benchmark_country_scoring")


@query(f"""{_P}, f AS (SELECT spec_id, pos, CASE WHEN i % 5 = 0 OR (pos - 1) % 3 = 1 THEN 'd' || pos ELSE i::VARCHAR END AS dimension_id, a AS label FROM l WHERE k % 4 = 0 AND i % 11 <> 0
 UNION ALL SELECT spec_id, npos, i::VARCHAR, a FROM p WHERE k % 8 = 2 AND i % 11 <> 0 AND i % 5 <> 0 AND (pos - 1) % 3 = 1) SELECT * FROM f UNION ALL {_NONE}""")
def stub_dimensions(t: Tables) -> DataFrame:
    return extraction.stub_benchmark(_benchmarks(t))[0]


def _countries(t: Tables) -> DataFrame:
    return _loose(t, extraction.COUNTRIES, {"country_name": _names(), "iso3": F.lower(F.left("b", F.lit(3)))})


_PLACED = "SELECT spec_id, 1, 'placeholder_country', 'XXX' FROM s WHERE spec_id NOT IN (SELECT spec_id FROM f)"


@query(f"{_P}, f AS (SELECT spec_id, pos, a AS country_name, upper(left(b, 3)) AS iso3 FROM l WHERE i % 11 <> 0) SELECT * FROM f UNION ALL {_PLACED}")
def extract_countries(t: Tables) -> DataFrame:
    return extraction.extract_countries(_countries(t))


@query(f"{_P}, f AS (SELECT spec_id, pos, a AS country_name, upper(left(b, 3)) AS iso3 FROM l WHERE k % 4 = 0 AND i % 11 <> 0) SELECT * FROM f UNION ALL {_PLACED}")
def stub_countries(t: Tables) -> DataFrame:
    return extraction.stub_benchmark(_countries(t))[1]
