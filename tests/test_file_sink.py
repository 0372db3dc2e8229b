import json
import pathlib

import pytest
from pyspark.sql import functions as F

from evispark import cli
from evispark.operators import rendering
from evispark.sources import files, office
from evispark.sources.file_sink import FileWriter, Written, write_files

EVIDENCE = {"quality": "low", "rationale": "r", "citations": [{"source_title": "T", "locator": "p. 1"}]}


def found(path):
    return sorted((p.name, p.read_bytes()) for p in pathlib.Path(path).rglob("*") if p.is_file() and p.suffix != ".crc")


def outputs(spark, *values):
    return spark.createDataFrame([(f"o{i}", json.dumps(v)) for i, v in enumerate(values)], "name string, json string")


def test_many_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(10_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("content"), F.lit(1).alias("other"))
    write_files(rows.repartition(7), path)
    assert found(path) == sorted((f"f{i}", str(i).encode()) for i in range(10_000))
    write_files(rows.where("name IN ('f0', 'f1')").withColumn("content", F.when(F.col("name") > "f0", F.encode("content", "UTF-8"))), path)
    assert found(path) == [("f0", b""), ("f1", b"1")] and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="FileExists"):
        write_files(rows, path, overwrite=False)
    write_files(rows.where("name = ''"), path)
    assert found(path) == []


def test_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_files(spark.createDataFrame([("a", "1")], "name string, content string"), path)
    for names in (["b", "b"], ["b", "x/y"], ["b", None]):
        with pytest.raises(Exception, match="named"):
            write_files(spark.createDataFrame([(n, "2") for n in names], "name string, content string").coalesce(1), path)
        assert found(path) == [("a", b"1")] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_attempts_that_do_not_count_go(spark, tmp_path):
    schema = spark.createDataFrame([], "name string, content string").schema
    writer = FileWriter(str(tmp_path / "out"), schema, True)
    lost, kept = writer.write(iter([{"name": "a", "content": "lost"}])), writer.write(iter([{"name": "a", "content": "kept"}]))
    writer.commit([kept, Written(None, 0), None])
    assert found(tmp_path) == [("a", b"kept")] and lost.folder != kept.folder


def test_workbooks(spark, tmp_path):
    rrr = {"solutions": [{"solution_id": "s1", "solution": "S", "mechanism": None, "evidence": EVIDENCE, "risks": ["a", "b"]}]}
    made = outputs(spark, rrr, {"solutions": []}, {})
    write_files(rendering.files(made, "rrr_evidence_matrix", "xlsx"), f"file:{tmp_path / 'w'}")
    got = {n: office.read_xlsx(c) for n, c in found(tmp_path / "w")}
    table = rendering.flat_tables(made, "rrr_evidence_matrix")["data"]
    assert got["o0.xlsx"] == [table.columns, list(table.first())] and got["o1.xlsx"] == got["o2.xlsx"] == [table.columns]
    score = {"score": "1", "evidence": EVIDENCE}
    bench = {"countries": [{"country_name": "A", "iso3": "AAA", "overall_score": score, "dimensions": [{"dimension_id": "d", "label": "L", "score_note": score}]}, {"country_name": "B"}]}
    made = outputs(spark, bench)
    content = rendering.files(made, "benchmark_country_scoring", "xlsx").first()["content"]
    for name, t in rendering.flat_tables(made, "benchmark_country_scoring").items():
        assert office.read_xlsx(bytes(content), name) == [t.columns, *map(list, t.collect())]
    with pytest.raises(KeyError):
        rendering.files(made, "phase1_discovery_qa", "xlsx")
    with pytest.raises(ValueError):
        rendering.files(made, "phase1_discovery_qa", "odt")


def test_documents(spark):
    made = outputs(spark, {"questions": [{"question": "Q <1>?", "answer": "A\nB", "evidence": EVIDENCE}, {"question": None}]}, {})
    got = {r["name"]: [t for _, _, t, _ in files.docx_blocks(bytes(r["content"]))] for r in rendering.files(made, "phase1_discovery_qa", "docx").collect()}
    assert got["o0.docx"][:2] == ["phase1_discovery_qa", "Q <1>?"] and "Rationale: r" in got["o0.docx"] and any("T — p. 1" in t for t in got["o0.docx"])
    assert got["o1.docx"] == ["phase1_discovery_qa"]
    with pytest.raises(KeyError):
        rendering.files(made, "rrr_evidence_matrix", "docx")


def test_command(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"questions": [{"question": f"Q{i}", "answer": "A"}]}))
    for form in ("md", "docx"):
        assert cli.main(["render-files", "--job", "phase1_discovery_qa", "--payloads", str(tmp_path / "*.json"), "--out", str(tmp_path / form), "--form", form]) == 0
        assert [n for n, _ in found(tmp_path / form)] == [f"p{i}.{form}" for i in range(3)]
