import json

import pytest
from pyspark.sql import functions as F

from evispark.operators import extraction, rendering, stubs, validation
from evispark.plans import generation, prompts


def specs(spark, *values):
    return spark.createDataFrame([(f"s{i}", json.dumps(v)) for i, v in enumerate(values)], "spec_id string, json string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("spec_id", "pos").collect()]


def test_alias_priority_and_seeds(spark):
    both = {"intervention_families_seed_list": ["a_b", "c", "d"], "solutions": [{"solution_id": "x", "intervention": "I", "mechanism": "m"}, {"title": "T"}]}
    assert rows(extraction.extract(specs(spark, both), "rrr_evidence_matrix"), "solution_id", "solution", "mechanism") == [("x", "I", "m"), ("s2", "T", "")]
    seeds = {"intervention_families_seed_list": ["task_shifting", " ", "pay"]}
    assert rows(extraction.extract(specs(spark, seeds), "rrr_evidence_matrix"), "solution_id", "solution") == [("int_1", "Task Shifting"), ("int_3", "Pay")]


def test_fallbacks(spark):
    t2 = {"levels": [{"level_id": "i", "label": "Individual", "primary_factors": ["a", "b"]}, {"id": "w", "name": "Work"}, "x"]}
    got = rows(extraction.extract(specs(spark, t2), "table2_root_cause_mapping"), "item_id", "root_cause", "definition")
    assert [g[0] for g in got] == ["i", "w"] and "including a, b (" in got[0][2] and "various factors" in got[1][2]
    t3 = {"domains": ["work_force", "tools"], "objectives": ["cut_cost", "help"]}
    got = rows(extraction.extract(specs(spark, t3), "table3_intervention_framework"), "intervention_id", "lever", "mechanism")
    assert got[0] == ("int_1", "Work Force", "Interventions in the Work Force domain targeting: cut cost, help") and len(got) == 2
    bench = {"phase2": {"criteria": [{"criterion_id": "P2", "name": "N"}]}, "phase3": {"criteria": [{"name": "M"}]}}
    assert rows(extraction.extract(specs(spark, bench, {}), "benchmark_country_scoring"), "dimension_id", "label") == [("P2", "N"), ("d2", "M"), ("d1", "placeholder_dimension")]
    assert rows(extraction.extract_countries(specs(spark, {"countries": [{"name": "A", "ISO3": "abc"}]}, {})), "country_name", "iso3") == [("A", "ABC"), ("placeholder_country", "XXX")]


def test_stub_reads_benchmarks_its_own_way(spark):
    bench = {"phase2": {"criteria": [{"criterion_id": "P2", "label": "L", "name": "N"}, {"name": "no id"}]}, "others": [{"label": "by its looks"}]}
    dims, who = extraction.stub_benchmark(specs(spark, bench, {"dimensions": [{"title": "T"}], "candidates": [{"name": "A", "iso3": "abc"}]}))
    assert rows(dims, "dimension_id", "label") == [("P2", "N"), ("d1", "T")]
    assert rows(who, "country_name", "iso3") == [("placeholder_country", "XXX"), ("A", "ABC")]


def test_nothing_found(spark):
    with pytest.raises(ValueError):
        extraction.require_items(extraction.extract(specs(spark, {"a": 1}), "country_learning_briefs"), "country_learning_briefs")
    with pytest.raises(KeyError):
        extraction.extract(specs(spark, {}), "unknown")


@pytest.mark.parametrize("job", sorted(extraction.EXTRACTORS))
def test_stubs_render_and_parse(spark, job):
    spec = {"questions": [{"id": "q", "text": "Q?"}], "solutions": [{"solution": "S"}], "framework_items": [{"category": "C", "cause": "R", "details": "D"}], "interventions": [{"lever": "L", "name": "N", "description": "D"}], "domains": [{"label": "D"}], "dimensions": [{"label": "X"}]}
    made = stubs.stub_outputs(specs(spark, spec), job, "2024-01-02", country_name="Land", country_iso3="LND")
    payload = json.loads(made.first()["json"])
    assert payload["job_id"] == job and payload["generated_at"] == "2024-01-02"
    text = rendering.markdown(made, job).first()["markdown"]
    assert text.startswith(f"# {job}\n- **spec_id**: s0\n- **generated_at**: 2024-01-02") and text.endswith("\n")
    if job in rendering.FLAT:
        assert rendering.flat_tables(made, job)["data"].first()["evidence_quality"] == "none"
    elif job == "benchmark_country_scoring":
        sheets = rendering.flat_tables(made, job)
        assert sheets["countries"].first()["overall_score"] == "0" and sheets["dimensions"].first()["label"] == "X"
    else:
        assert rendering.narrative_rows(made, job).count() == 1
        with pytest.raises(KeyError):
            rendering.flat_tables(made, job)


def test_citation_lines(spark):
    c = "struct<source_title:string,locator:string,source_url:string,published_date:string,quote:string>"
    df = spark.createDataFrame([([("T", "p. 1", "http://x", "2024-01-01", "q"), (None, "", None, None, None)],), ([],)], f"c array<{c}>")
    got = [r[0] for r in df.select(rendering.citation_lines(F.col("c"))).collect()]
    assert got == ["**Citations**:\n1. T (2024-01-01) — p. 1 — http://x\n   - _Quote_: q\n2. Unknown source", ""]
    assert df.select(rendering.flat_citations(F.col("c"))).first()[0] == "T | p. 1 | http://x"


def test_cleaning_and_gates(spark):
    names = ("source_id", "source_url", "reference", "doi", "isbn", "publisher", "quote", "source_type", "published_date", "authors")
    cases = [(" ", "http://example.com/a", None, "", None, "p", "", "web", "2024-1-1", "a"), ("S", "https://a.b", None, None, None, None, None, None, "2024-13-45", None), (None, "ftp://a", None, None, " ", None, None, None, None, None)]
    df = spark.createDataFrame([(c,) for c in cases], "c struct<" + ",".join(f"{n}:string" for n in names) + ">")
    got = [r[0] for r in df.select(validation.clean_citation(F.col("c"))).collect()]
    assert (got[0]["source_id"], got[0]["source_url"], got[0]["publisher"], got[0]["published_date"]) == (" ", None, "p", None)
    assert (got[1]["source_url"], got[1]["published_date"], got[2]["source_url"]) == ("https://a.b", "2024-13-45", None)
    assert [r[0] for r in df.select(validation.identified(F.col("c"))).collect()] == [True, True, False]


def test_predicates(spark):
    df = spark.createDataFrame([('{"a":1}', ["x"], None), ('{"a":1,"z":2}', [], "q")], "j string, xs array<string>, s string")
    got = validation.violations(df, {"keys": validation.only_keys(F.col("j"), ["a"]), "items": validation.items(F.col("xs"), 1, 3), "s": validation.required(F.col("s"))}, ["j"])
    assert sorted((r["j"], r["path"]) for r in got.collect()) == [('{"a":1,"z":2}', "items"), ('{"a":1,"z":2}', "keys"), ('{"a":1}', "s")]
    e = "e struct<quality:string,rationale:string,citations:array<string>>"
    df = spark.createDataFrame([(("none", "r", []),), (("none", "r", ["c"]),), (("high", "r", []),), (("odd", "r", []),)], e)
    assert [r[0] for r in df.select(validation.evidence_union(F.col("e"))).collect()] == [True, False, True, False]
    assert [r[0] for r in validation.allowed_ids(listed=" a, b,,a", spark=spark).orderBy("source_id").collect()] == ["a", "b"]


def test_prompts(spark):
    df = specs(spark, {"questions": [{"id": "q", "text": "Q?"}]})
    sources = spark.createDataFrame([("SRC1", "t", 0, [("x", "text")])], "source_id string, source_title string, pos int, snippets array<struct<text:string,type:string>>")
    p = prompts.job_prompt(df, "T\n\n", "phase1_discovery_qa", "Land", None, sources).first()["prompt"]
    head, _, rest = p.partition("(machine-generated)\n")
    body = json.loads(rest.partition("\n\n## IMPORTANT")[0])
    assert head == "T\n\n## RENDERED INPUTS " and body["country_iso3"] is None and body["allowed_sources"][0]["source_id"] == "SRC1" and p.endswith(prompts.SOURCE_IDS)
    with pytest.raises(ValueError):
        prompts.job_prompt(df, "T", "phase1_discovery_qa")
    assert prompts.rag_queries(df, "phase1_discovery_qa").first()["query"] == "Q?"
    index = spark.createDataFrame([(0, "SRC1", "t", "l", "x", "text", [1.0]), (1, "SRC2", "t", "l", "y", "text", [0.5])], "pos int, source_id string, source_title string, locator string, text string, type string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0], ("Q?",))], "query_id int, query array<double>, inputs struct<question:string>")
    assert '"SRC1"' in prompts.rag_prompts(q, index, "T", 1).first()["prompt"]


def test_generation():
    waits = []

    def limited(p):
        if len(waits) < 3:
            raise generation.RateLimited
        return "[]"

    assert generation.ask(limited, "P", sleep=waits.append) == "[]" and waits == [30, 60, 120]


def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "i int, text string").coalesce(1)
    got = generation.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=3).orderBy("i").collect()
    assert [r["embedding"][0] for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


COMMON = {"$defs": {"Text": {"type": "string", "minLength": 1}, "Cite": {"type": "object", "additionalProperties": False, "required": ["t"], "properties": {"t": {"$ref": "#/$defs/Text"}, "u": {"type": "string"}, "d": {"type": "string"}}, "anyOf": [{"required": ["u"]}, {"required": ["d"]}]}}}
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["job", "when", "items"],
    "properties": {"job": {"const": "x"}, "when": {"type": "string", "pattern": "^\\d{4}$"}, "n": {"type": "number", "minimum": 0, "maximum": 100}, "items": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "common.json#/$defs/Cite"}}},
}


def test_schema_documents(spark):
    from evispark.plans.schema import schema_errors

    good = {"job": "x", "when": "2024", "n": 5, "items": [{"t": "a", "u": "b"}]}
    bad = {"job": "y", "n": 101, "extra": 1, "items": [{"t": ""}, {"u": "b"}, {"t": "a", "d": "", "z": 1}]}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, "{"), (2, json.dumps({**good, "when": "x"})), (3, json.dumps(bad))], "n int, json string").coalesce(1)
    found = [(r["n"], r["error"].split(":")[0]) for r in schema_errors(df, SCHEMA, {"schemas/common.json": COMMON}, ("n",)).collect()]
    assert [n for n, _ in found[:2]] == [1, 2]
    paths = [p for n, p in found if n == 3]
    assert paths == sorted(paths) and set(paths) == {"$", "$.items", "$.items[0]", "$.items[0].t", "$.items[1]", "$.items[2]", "$.job", "$.n"}


def output(job, key, *items):
    return json.dumps({"job_id": job, "spec_id": "s", "generated_at": "2024-01-01", key: list(items)})


def test_merge_outputs(spark):
    from evispark.plans import jobs

    ev = lambda q, *c: {"quality": q, "rationale": q, "citations": [{"source_title": "t", "locator": x, "source_url": "http://example.com"} for x in c]}
    job = "phase1_discovery_qa"
    a = output(job, "questions", {"question_id": "Q2", "answer": "A", "evidence": ev("low", "1")}, {"question_id": "Q1", "answer": "x", "evidence": ev("none")})
    b = output(job, "questions", {"question_id": "Q1", "answer": "y", "evidence": ev("high", "2")}, {"question_id": "Q3", "answer": "z", "evidence": ev("none")}, {"question_id": "Q2", "answer": "A", "evidence": ev("high", "1", "3")})
    df = spark.createDataFrame([(0, a), (1, b)], "batch int, json string")
    got = json.loads(jobs.merge_outputs(df, job).first()["json"])
    assert [(q["question_id"], q["answer"], q["evidence"]["quality"], len(q["evidence"]["citations"])) for q in got["questions"]] == [("Q2", "A", "high", 2), ("Q1", "x\n\ny", "high", 1), ("Q3", "z", "none", 0)]
    assert jobs.merge_outputs(df.limit(1), job).first()["json"] == a
    with pytest.raises(ValueError):
        jobs.merge_outputs(df.where("batch > 5"), job)
    with pytest.raises(KeyError):
        jobs.merge_outputs(df, "unknown")
    cleaned = json.loads(jobs.clean_outputs(df.where("batch = 0"), job).first()["json"])
    assert "source_url" not in cleaned["questions"][0]["evidence"]["citations"][0]


def test_runs_with_a_provider(spark):
    from evispark.plans import jobs

    job = "phase1_discovery_qa"
    df = specs(spark, {"questions": [{"id": "a", "text": "One?"}, {"id": "b", "text": "Two?"}]})

    def provider(prompt):
        name = "a" if "One?" in prompt.split("MACHINE")[-1] else "b"
        return json.dumps({"job_id": "phase1_discovery_qa", "spec_id": "s", "generated_at": "2024-01-01", "questions": [{"question_id": name, "answer": str(len(prompt) > 0), "evidence": {"quality": "none", "rationale": "r", "citations": []}}]})

    index = spark.createDataFrame([(0, "SRC1", "t", "l", "x", "text", [1.0])], "pos int, source_id string, source_title string, locator string, text string, type string, embedding array<double>")
    got = json.loads(jobs.run_rag(df, job, index, "T", provider, lambda ts: [[1.0] for _ in ts]).first()["json"])
    assert [q["question_id"] for q in got["questions"]] == ["a", "b"]
    kind = "source_id string, source_title string, pos int, snippets array<struct<text:string,type:string>>"
    sources = spark.createDataFrame([("S1", "t", 0, [("x", "text")]), ("S2", "t", 1, [("y", "text")]), ("S3", "t", 2, [])], kind)
    got = json.loads(jobs.run_batches(df, job, sources, "T", provider, country_name="Land").first()["json"])
    assert len(got["questions"]) == 1 and got["questions"][0]["answer"] == "True"
