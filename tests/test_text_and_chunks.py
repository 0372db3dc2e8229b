import random

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import chunking, selection


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_strip_is_unicode(spark):
    assert one(spark, "  \tä b \n", tx.strip) == "ä b"


def test_first_filled(spark):
    df = spark.createDataFrame([("", "b"), ("  ", "b"), (None, None), (None, " c ")], "a string, b string")
    assert [r[0] for r in df.select(tx.first_filled(F.col("a"), F.col("b"))).collect()] == ["b", "", "", "c"]


def test_slug_title_dates_addresses(spark):
    assert one(spark, "  Hello, World - x_y  ", tx.slugify) == "hello_world_x_y"
    assert one(spark, "task_shifting", tx.humanise) == "Task Shifting"
    assert [one(spark, x, tx.is_iso_date) for x in ("2024-13-45", "2024-1-1", None)] == [True, False, None]
    assert [one(spark, x, tx.is_web_address) for x in ("http://a.b/c", "https://", "ftp://a", "not a url", None)] == [True, False, False, False, False]


def test_bytes(spark):
    assert one(spark, bytearray("é–".encode()), tx.read_text, "binary") == "é–"
    assert one(spark, bytearray("é–".encode("cp1252")), tx.read_text, "binary") == "é–"


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([["a", "b"], ["1", None]], "| a | b |\n| --- | --- |\n| 1 |  |"),
        ([["a|b"], ["x\ny", "z"]], "| a\\|b |\n| --- |\n| x y |"),
        ([["a", "b"]], "| a | b |\n| --- | --- |"),
        ([], ""),
        ([[]], ""),
    ],
)
def test_markdown_table(spark, rows, expected):
    assert one(spark, rows, tx.markdown_table, "array<array<string>>") == expected


def model(text, limit):
    parts = text.split("\n\n")
    parts = parts if len(parts) > 1 else text.split("\n")
    chunks, cur, n = [], [], 0
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if cur and n + len(p) + 1 > limit:
            chunks.append("\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p) + 1
    return chunks + (["\n".join(cur)] if cur else [])


def test_chunks_against_model(spark):
    r = random.Random(5)
    texts = ["short", "x" * 300, "\n\n".join("p" * r.randrange(1, 60) for _ in range(20)), "a" * 100 + "\n\n" + "b" * 100, "  \n" * 80]
    texts += ["\n".join("w" * r.randrange(0, 50) for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame([(str(i), t, "text") for i, t in enumerate(texts)] + [("t", "z" * 999, "table")], "locator string, text string, type string")
    got: dict = {}
    for row in chunking.chunk_snippets(df, 120).orderBy("part").collect():
        got.setdefault(row["locator"].split(" (")[0], []).append((row["locator"], row["text"]))
    for i, t in enumerate(texts):
        want = [t] if len(t) <= 120 else model(t, 120)
        assert [x for _, x in got.get(str(i), [])] == want
        if len(want) > 1:
            assert got[str(i)][1][0] == f"{i} (part 2)"
    assert got["t"] == [("t", "z" * 999)]


def test_sections(spark):
    blocks = [(1, 0, False, "a"), (1, 1, False, " "), (1, 2, False, "b"), (1, 3, True, "T"), (1, 4, True, "U"), (1, 5, False, "c")]
    df = spark.createDataFrame(blocks, "doc int, pos int, tb boolean, text string")
    got = chunking.section_islands(df, "doc", "pos", "tb", "text").orderBy("section").collect()
    assert [(r["locator"], r["text"]) for r in got] == [("Section 1", "a\nb"), ("Table in section 2", "T"), ("Table in section 3", "U"), ("Section 4", "c")]


def test_numbering(spark):
    files = spark.createDataFrame([("b", 0), ("a", 1), ("c", 0)], "name string, k int")
    assert {r["name"]: r["source_id"] for r in chunking.number_sources(files, F.col("k")).collect()} == {"b": "SRC1", "c": "SRC2", "a": "SRC3"}
    tables = spark.createDataFrame([("d", 1, 0), ("d", 2, 0), ("d", 2, 1)], "doc string, page int, pos int")
    assert sorted(r["locator"] for r in chunking.number_tables(tables, "doc", "page", "pos").collect()) == ["Table 1 on p. 2", "Table 2 on p. 2", "Table on p. 1"]


SOURCES = "source_id string, source_title string, pos int, snippets array<struct<text:string,type:string>>"


def budget_model(sources, limit):
    if sum(len(t) for s in sources for t, _ in s) <= limit:
        return sources
    share, left, out = limit // len(sources), limit, []
    for s in sources:
        room, kept = max(0, min(share, left)), []
        for t, k in sorted(s, key=lambda x: x[1] != "table"):
            if len(t) <= room:
                kept.append((t, k))
                room -= len(t)
                left -= len(t)
        out.append(kept)
    return out


@pytest.mark.parametrize("limit", [0, 30, 55, 1000])
def test_budget(spark, limit):
    r = random.Random(limit)
    sources = [[("x" * r.randrange(1, 20), r.choice(["text", "table"])) for _ in range(5)] for _ in range(4)]
    df = spark.createDataFrame([(f"S{i}", "t", i, s) for i, s in enumerate(sources)], SOURCES)
    got = selection.trim_sources(df, limit).orderBy("pos").collect()
    assert [[tuple(x) for x in r["snippets"]] for r in got] == budget_model(sources, limit)


def test_batches_and_queries(spark):
    df = spark.createDataFrame([("A", "t", 0, [("x", "text")]), ("B", "t", 1, []), ("C", "t", 2, [("y", "text")])], SOURCES)
    assert sorted((r["batch"], r["source_id"]) for r in selection.source_batches(df).collect()) == [("A", "A"), ("A", "B"), ("C", "B"), ("C", "C")]
    cases = [("", "s"), ("  ", "s"), ("TBD", "s"), ("Tbd later", "s"), ("a Placeholder", "s"), ("To be determined x", "s"), (None, "s"), ("pay", "s — pay")]
    rows = spark.createDataFrame([("s", m) for m, _ in cases], "s string, m string").select(selection.solution_query(F.col("s"), F.col("m")).alias("q")).collect()
    assert [r["q"] for r in rows] == [q for _, q in cases]
