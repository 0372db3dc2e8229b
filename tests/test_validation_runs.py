"""Schemas and rules on citations from the command line, repaired answers, JSON forms, documents with pages."""

import json

import pytest
from pyspark.sql import functions as F
from tests import fake_provider

from evispark import cli
from evispark.operators import extraction, merging, selection
from evispark.plans import generation, schema
from evispark.sources import files, sinks

SCHEMA = {
    "type": "object", "required": ["questions"],
    "properties": {"questions": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"evidence": {"$ref": "common.json#/$defs/evidence"}}}}},
}
COMMON = {"$defs": {"evidence": {"type": "object", "properties": {"quality": {"enum": ["low", "high"]}}}}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "spec.json").write_text(json.dumps({"spec_id": "s", "questions": [{"id": "q1", "text": "Q?"}]}))
    (tmp_path / "t.md").write_text("Template")
    (tmp_path / "qa.schema.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "common.json").write_text(json.dumps(COMMON))
    (tmp_path / "r.yaml").write_text("version: v1\nproject: p\njobs:\n  - {job_id: phase1_discovery_qa, label: L, spec_file: spec.json, prompt_template: t.md, output_schema: qa.schema.json, output_dir: out}\n")
    sources = {"sources": [{"source_id": "SRC1", "source_title": "T", "snippets": [{"locator": "p. 1", "text": "x", "type": "text"}]}, {"source_id": "SRC2", "source_title": "U", "snippets": []}]}
    (tmp_path / "x_sources.json").write_text(json.dumps(sources))
    return tmp_path


def payload(folder, quality="low", **citation):
    cited = [{"source_title": "T", "locator": "p. 1", **citation}]
    out = folder / "p.json"
    out.write_text(json.dumps({"job_id": "phase1_discovery_qa", "spec_id": "s", "generated_at": "2024-01-01", "questions": [{"evidence": {"quality": quality, "citations": cited}}]}))
    return str(out)


@pytest.mark.parametrize(
    ("citation", "options", "code"),
    [
        ({}, [], 0), ({"quality": "odd"}, [], 3), ({"source_url": "http:///x"}, ["--strict-citations"], 3), ({"source_url": "https://a.org/x"}, ["--strict-citations"], 0),
        ({"doi": " "}, ["--strict-citations"], 3), ({"source_id": "SRC1"}, ["--allowed-sources", "SRC1, SRC2"], 0), ({"source_id": "SRC3"}, ["--allowed-sources", "SRC1"], 3), ({}, ["--allowed-sources", "SRC1"], 3),
    ],
)
def test_validate(spark, folder, citation, options, code):
    args = ["validate", "--registry", str(folder / "r.yaml"), "--job", "phase1_discovery_qa", "--payload", payload(folder, **citation)]
    assert cli.main(args + options) == code


def test_answers_are_repaired(spark, folder):
    provider = ["--mode", "llm", "--provider", "tests.fake_provider:answer", "--sources", str(folder / "x_sources.json"), "--country-name", "Land"]
    args = ["--registry", str(folder / "r.yaml"), *provider]
    assert cli.main(["run", *args, "--job", "phase1_discovery_qa", "--out", str(folder / "o1"), "--allowed-sources", "SRC1"]) == 0
    made = json.loads("".join(p.read_text() for p in (folder / "o1").glob("part-*")))
    assert [q["question_id"] for q in made["questions"]] == ["q1"]
    assert cli.main(["run-all", *args, "--out", str(folder / "o2")]) == 0
    assert cli.main(["run-all", *args, "--out", str(folder / "o3"), "--allowed-sources", "SRC9"]) == 1
    with pytest.raises(ValueError):
        generation.generate_all(spark.createDataFrame([("a", "p")], "k string, prompt string"), fake_provider.broken, "k", schema.Gate())


def test_the_gate_looks_at_citations_once_the_schema_holds(spark):
    gate = schema.Gate(schema.Schema({"required": ["a"]}), True, frozenset(["S"]))
    cite = lambda **k: {"a": [{"c": {"source_title": "t", "locator": "l", **k}}]}
    rows = [{}, cite(isbn="1"), cite(), cite(source_id="S"), cite(source_url="ftp://a.b"), cite(source_url=" https://a.b/c\n", source_id="S"), cite(source_id=7)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "n int, json string")
    got = {r["n"]: r["problems"] for r in schema.with_problems(df, gate).collect()}
    nothing, other = ["$.a[0].c: no identifier of the source"], ["$.a[0].c: source (none) is not allowed"]
    assert got == {0: ["$: 'a' is a required property"], 1: other, 2: nothing, 3: [], 4: nothing, 5: [], 6: nothing}


def test_json_forms(spark, tmp_path):
    rows = [("SRC2", "b", "docx", "b.docx", None, None, None, None, None), ("SRC1", "a", "pdf", "a.pdf", 1, 1, "p. 2", "y", "text"), ("SRC1", "a", "pdf", "a.pdf", 0, 1, "p. 1", "x", "table")]
    scanned = spark.createDataFrame(rows, "source_id string, source_title string, source_type string, path string, pos int, part int, locator string, text string, type string")
    sinks.write_sources_json(scanned, str(tmp_path / "s"))
    back = files.read_sources_json(spark, str(tmp_path / "s")).orderBy("pos").collect()
    assert [(r["source_id"], r["reference"], [s["text"] for s in r["snippets"]]) for r in back] == [("SRC1", "a (PDF document)", ["x", "y"]), ("SRC2", "b (DOCX document)", [])]
    index = scanned.where("text IS NOT NULL").withColumn("embedding", F.array(F.col("pos").cast("double"), F.lit(1.0)))
    sinks.write_index_json(index, str(tmp_path / "i"), "m")
    again = files.read_index_json(spark, str(tmp_path / "i")).orderBy("pos").collect()
    assert [(r["text"], r["embedding"], r["model"]) for r in again] == [("x", [0.0, 1.0], "m"), ("y", [1.0, 1.0], "m")]


def test_arrays_of_objects_are_folded(spark):
    df = spark.createDataFrame(
        [("i", 0, 0, []), ("i", 1, 0, [("a", 1), ("a", 1)]), ("i", 2, 0, [("b", None), ("a", 1), ("b", None)]), ("i", 3, 0, None), ("i", 4, 0, [("b", None), ("c", 2)])],
        "id string, batch int, pos int, risks array<struct<x:string,y:int>>",
    )
    got = merging.merge_items(df, "id", (), ("risks",)).first()["risks"]
    assert [tuple(x) for x in got] == [("a", 1), ("a", 1), ("b", None), ("b", None), ("c", 2)]


def test_many_citations_are_united_in_order(spark):
    cite = "struct<source_id:string,locator:string,source_title:string>"
    cites = [(str(i % 400), None if i % 2 else "", "t") for i in range(1_500)]
    df = spark.createDataFrame([(cites,)], f"c array<{cite}>")
    got = df.select(merging.dedup_citations(F.col("c")).alias("c")).first()["c"]
    assert [(r["source_id"], r["locator"]) for r in got] == [(str(i), None if i % 2 else "") for i in range(400)]


def test_no_budget_keeps_nothing(spark):
    kind = "array<struct<locator:string,text:string,type:string>>"
    sources = spark.createDataFrame([("S", 0, [("l", "", "text"), ("m", "x", "table")])], f"source_id string, pos int, snippets {kind}")
    assert selection.trim_sources(sources, 0).first()["snippets"] == []
    assert selection.first_fit(spark.createDataFrame([("a", "b", 1, 0, 0)], "lang string, source string, doc_id long, n long, k int"), ["lang"], ["source"], ["k"], "n", 0).count() == 0


def test_codes_without_a_name_stay(spark):
    names = spark.createDataFrame([(1, "one")], "k int, n string")
    got = selection.lookup_with_fallback(spark.createDataFrame([(1,), (2,), (None,)], "c int"), names, "c", "k", "n", "out").collect()
    assert sorted((r["c"] or 0, r["out"]) for r in got) == [(0, None), (1, "one"), (2, "2")]


def test_extraction_of_loose_specifications(spark):
    specs = [
        ("a", {"questions": [{"id": "x", "text": " One? "}, "skip", {"question": "Two?"}, {"qid": "z", "prompt": "  "}]}),
        ("b", {"note": 1, "things": [{"prompt": "Three?"}, {"prompt": "Four?"}]}),
        ("c", {"questions": [], "other": [{"question": "Five?", "question_id": ""}]}),
    ]
    got = extraction.extract(spark.createDataFrame([(k, json.dumps(v)) for k, v in specs], "spec_id string, json string"), "phase1_discovery_qa")
    want = [("a", 1, "x", "One?"), ("a", 3, "q3", "Two?"), ("b", 1, "q1", "Three?"), ("b", 2, "q2", "Four?"), ("c", 1, "q1", "Five?")]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_the_nearest_share_by_quantiles(spark, monkeypatch):
    from evispark.operators import comparator

    monkeypatch.setattr(comparator, "SORTED", 10)
    df = spark.range(3_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("Country"), (F.col("id") % 700).cast("double").alias("distance"))
    got = comparator._nearest_share(df, 0.5, 9, "Country").collect()
    want = sorted((float(i % 700), f"n{i}") for i in range(3_000))[:1_500]
    assert sorted((r["distance"], r["Country"]) for r in got) == want
