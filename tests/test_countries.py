"""Runs over many countries: folders, the catalogue, latest runs by pruning, failures that stop nothing else."""

import json
import zipfile
from datetime import datetime

from evispark import cli
from evispark.plans import countries, schema

WORD = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Some text.</w:t></w:r></w:p></w:body></w:document>'


def docx(path):
    path.parent.mkdir(parents=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", WORD)


def test_folders_and_names(spark, tmp_path):
    for name in ("ETH", "ken", "data", "KE"):
        docx(tmp_path / "src" / name / "docx" / "a.docx")
    (tmp_path / "src" / "ABC.txt").write_text("no folder")
    found = countries.country_folders(spark, str(tmp_path / "src")).collect()
    assert [tuple(r) for r in found] == [("ETH", "ETH"), ("ken", "ken")]
    names = spark.createDataFrame([("eth", "Ethiopia"), ("KEN", "Kenya")], "country_iso3 string, country_name string")
    assert [r["country_name"] for r in countries.country_folders(spark, str(tmp_path / "src"), names).collect()] == ["Ethiopia", "Kenya"]


def test_a_failing_country_stops_nothing_and_the_latest_runs_are_read_alone(spark, tmp_path):
    where, finished = str(tmp_path / "catalogue"), []
    listed = spark.createDataFrame([("AAA", "A"), ("BBB", "B"), ("CCC", "C")], "country_iso3 string, country_name string")
    gate = schema.Gate(schema.Schema({"required": ["a"]}))

    def prepare(iso3):
        if iso3 == "BBB":
            raise FileNotFoundError("no files")
        return iso3

    def make(wrong):
        return lambda job, country, sources: spark.createDataFrame([("{}" if (sources, job) == wrong else json.dumps({"a": job}),)], "json string")

    go = lambda wrong, day: list(countries.run_countries(spark, listed, ["j1", "j2"], prepare, make(wrong), lambda j: gate, where, lambda *a: finished.append(a[:2]), datetime(2024, 1, day)))
    assert go(("CCC", "j2"), 1) == [("AAA", "j1", "SUCCESS"), ("AAA", "j2", "SUCCESS"), ("BBB", "j1", "FAILED"), ("BBB", "j2", "FAILED"), ("CCC", "j1", "SUCCESS"), ("CCC", "j2", "FAILED")]
    assert finished == [("j1", "AAA"), ("j2", "AAA"), ("j1", "CCC")]
    go(None, 2)
    runs = countries.read_catalogue(spark, where)
    assert runs.count() == 12
    latest = countries.latest_runs(runs)
    assert {r["run"] for r in latest.collect()} == {"20240102_000000"} and latest.count() == 6
    assert "dynamicpruning" in latest._jdf.queryExecution().executedPlan().toString().lower() or "PartitionFilters" in latest._jdf.queryExecution().executedPlan().toString()
    got = {r["country_iso3"]: (r["jobs"], r["failed"], r["success"]) for r in countries.summary(latest).collect()}
    assert got == {"AAA": (2, 0, True), "BBB": (2, 2, False), "CCC": (2, 0, True)}
    assert {r["message"] for r in latest.where("country_iso3 = 'BBB'").collect()} == {"FileNotFoundError: no files"}


def test_the_command(spark, tmp_path, capsys):
    docx(tmp_path / "src" / "ETH" / "docx" / "a.docx")
    (tmp_path / "src" / "KEN").mkdir()
    (tmp_path / "src" / "KEN" / "note.txt").write_text("nothing to scan")
    (tmp_path / "spec.json").write_text(json.dumps({"spec_id": "s", "questions": [{"id": "q1", "text": "Q?"}]}))
    (tmp_path / "t.md").write_text("Template")
    (tmp_path / "qa.schema.json").write_text("{}")
    (tmp_path / "r.yaml").write_text("version: v1\nproject: p\njobs:\n  - {job_id: phase1_discovery_qa, label: L, spec_file: spec.json, prompt_template: t.md, output_schema: qa.schema.json, output_dir: out}\n")
    args = ["run-countries", "--registry", str(tmp_path / "r.yaml"), "--folder", str(tmp_path / "src"), "--out", str(tmp_path / "o")]
    assert cli.main(args) == 1
    said = capsys.readouterr().out
    assert "ETH phase1_discovery_qa: SUCCESS" in said and "KEN phase1_discovery_qa: FAILED" in said and "ETH: SUCCESS, 1 jobs, 0 failed" in said
    assert list((tmp_path / "o" / "rendered" / "ETH" / "phase1_discovery_qa").iterdir())
    (tmp_path / "src" / "KEN" / "note.txt").unlink()
    docx(tmp_path / "src" / "KEN" / "docx" / "b.docx")
    llm = ["--mode", "llm", "--provider", "tests.fake_provider:answer", "--store", str(tmp_path / "store")]
    assert cli.main([*args, *llm]) == 0
