import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evispark import cli
from evispark.plans import jobs
from evispark.sources import files, registry, sinks
from evispark.streaming import arrivals

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*parts):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(x) if isinstance(x, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in x) + "</w:tbl>" for x in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_scan(spark, tmp_path):
    def fake_pdf(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [(1, "table", "", [["t"]]), (1, "text", "page", [])]

    (tmp_path / "pdf").mkdir()
    (tmp_path / "docx").mkdir()
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"pages")
    (tmp_path / "docx" / "c.docx").write_bytes(docx("one", "two", [["h", "k"], ["1", "2"]], "three"))
    readers = {"docx": files.docx_blocks, "pdf": fake_pdf}
    got = jobs.scan_sources(spark, str(tmp_path), readers).orderBy("source_id", "pos").collect()
    assert [(r["source_id"], r["locator"], r["text"]) for r in got] == [
        ("SRC1", "Table on p. 1", "| t |\n| --- |"), ("SRC1", "p. 1", "page"), ("SRC2", None, None),
        ("SRC3", "Section 1", "one\ntwo"), ("SRC3", "Table in section 2", "| h | k |\n| --- | --- |\n| 1 | 2 |"), ("SRC3", "Section 3", "three"),
    ]
    with pytest.raises(FileNotFoundError):
        files.scan_directory(spark, str(tmp_path / "docx"), ("pdf",))


def test_html():
    got = files.html_blocks(b"<h1>T</h1><p>a <b>b</b></p><script>x</script><table><tr><th>h</th></tr><tr><td>1</td></tr></table><li>c</li>")
    assert [(k, t, r) for _, k, t, r in got] == [("text", "T", []), ("text", "a b", []), ("table", "", [["h"], ["1"]]), ("text", "c", [])]


def test_json_and_registry(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('{"x": "é–"}'.encode("cp1252"))
    assert json.loads(files.read_json_documents(spark, str(tmp_path / "a.json")).first()["json"]) == {"x": "é–"}
    spec = {"spec_id": "v1", "questions": [{"id": "q", "text": "Q?"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    (tmp_path / "t.md").write_text("Template")
    (tmp_path / "s.json").write_text("{}")
    job = "  - {job_id: phase1_discovery_qa, label: L, spec_file: spec.json, prompt_template: t.md, output_schema: s.json, output_dir: out}\n"
    (tmp_path / "r.yaml").write_text("version: v1\nproject: p\njobs:\n" + job + job.replace("label: L", "label: M"))
    listed = registry.load_registry(spark, str(tmp_path / "r.yaml"))
    assert listed.count() == 1 and registry.job(listed, "phase1_discovery_qa").label == "M"
    with pytest.raises(KeyError):
        registry.job(listed, "x")
    (tmp_path / "bad.yaml").write_text("version: v1\nproject: ' '\njobs: []\n")
    with pytest.raises(ValueError):
        registry.load_registry(spark, str(tmp_path / "bad.yaml"))
    args = ["--registry", str(tmp_path / "r.yaml"), "--job", "phase1_discovery_qa", "--country-name", "Land"]
    assert cli.main(["run", *args, "--out", str(tmp_path / "o1"), "--generated-at", "2024-01-01"]) == 0
    assert cli.main(["prompt", *args, "--out", str(tmp_path / "o2")]) == 0
    assert "Q?" in "".join(p.read_text() for p in (tmp_path / "o2").glob("part-*"))
    assert cli.main(["run-all", "--registry", str(tmp_path / "r.yaml"), "--out", str(tmp_path / "o3"), "--country-name", "Land"]) == 0
    assert cli.main(["render-all", "--registry", str(tmp_path / "r.yaml"), "--out", str(tmp_path / "o4")]) == 1
    payload = tmp_path / "p.json"
    payload.write_text(json.dumps({"job_id": "phase1_discovery_qa", "spec_id": "s"}))
    assert cli.main(["validate", "--job", "phase1_discovery_qa", "--payload", str(payload)]) == 3
    assert cli.main(["render", "--job", "phase1_discovery_qa", "--payload", str(payload), "--out", str(tmp_path / "o5")]) == 0


def test_latest_and_names(spark, tmp_path):
    import os

    for i, run in enumerate(("a_20240101_000000", "b_20240102_000000")):
        d = tmp_path / "job1" / run
        d.mkdir(parents=True)
        (d / "output_stub.json").write_text("{}")
        os.utime(d / "output_stub.json", (1e9 + i * 100, 1e9 + i * 100))
    got = files.latest_outputs(spark, str(tmp_path), "stub").collect()
    assert [(r["job_id"], "b_2024" in r["path"]) for r in got] == [("job1", True)]
    assert files.latest_outputs(spark, str(tmp_path / "none"), "stub").count() == 0
    assert sinks.index_name("x/land_sources.json") == "x/land_index"
    assert sinks.run_folder("o/land_20240101_000000", "j") == "o/land_20240101_000000" and sinks.run_folder("o", "j", "Land").startswith("o/j/land_")
    names = spark.createDataFrame([("ETH",), ("eth",), ("E1H",), ("ETHI",)], "n string")
    assert [r[0] for r in names.select(files.is_country_folder(F.col("n"))).collect()] == [True, True, False, False]
    s = sinks.status_summary(spark.createDataFrame([("SUCCESS",), ("SKIP",)], "status string")).collect()
    assert {r["status"]: r["failed"] for r in s} == {"SUCCESS": False, "SKIP": True}


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("S", "d", "x" * 50 + "\n" + "y" * 60, "text")], "source_id string, locator string, text string, type string").write.parquet(str(tmp_path / "in"))
    q = arrivals.stream_snippets(spark, str(tmp_path / "in"), 80).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 2


def test_office_files(spark, tmp_path):
    from evispark.sources import office

    df = spark.createDataFrame([("a <b>", "x\ny", 1.5), (None, "z", 2.0)], "p string, q string, n double")
    path = str(tmp_path / "t.xlsx")
    sinks.write_xlsx({"one": df, "two": df.select("q")}, path)
    content = (tmp_path / "t.xlsx").read_bytes()
    assert office.read_xlsx(content) == [["p", "q", "n"], ["a <b>", "x\ny", "1.5"], ["", "z", "2.0"]]
    assert [r["q"] for r in files.read_table(spark, path, "two").collect()] == ["x\ny", "z"]
    with pytest.raises(ValueError):
        office.read_xlsx(content, "three")
    assert [office.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    rows = spark.createDataFrame([(0, "H", "B", "low", "r", "c")], "pos int, heading string, body string, quality string, rationale string, citations string")
    sinks.write_docx("T", rows, str(tmp_path / "d.docx"))
    assert [t for _, _, t, _ in files.docx_blocks((tmp_path / "d.docx").read_bytes())][:3] == ["T", "H", "B"]
