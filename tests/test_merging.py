import pytest

from evispark.operators import merging

CITE = "struct<source_id:string,locator:string,source_title:string>"
SCHEMA = f"item_id string, batch int, pos int, category string, definition string, tags array<string>, evidence struct<quality:string,rationale:string,citations:array<{CITE}>>"


def merge(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = merging.merge_items(df, "item_id", ("definition",), ("tags",), "evidence").orderBy("item_order").collect()
    return {r["item_id"]: r for r in found}


def ev(q, why="", *cites):
    return (q, why, [(s, loc, None) for s, loc in cites])


def test_texts_accumulate(spark):
    rows = [("i", b, 0, "c", t, [], ev("none")) for b, t in enumerate(["A", "B", "A", "", None])]
    got = merge(spark, rows)["i"]
    assert got["definition"] == "A\n\nB\n\nA"
    assert merge(spark, [("i", b, 0, "c", t, [], ev("none")) for b, t in enumerate(["A", "A"])])["i"]["definition"] == "A"


def test_arrays(spark):
    rows = [("i", 0, 0, "c", "", [], ev("none")), ("i", 1, 0, "c", "", ["x", "x"], ev("none")), ("i", 2, 0, "c", "", ["y", "x", "y"], ev("none"))]
    assert merge(spark, rows)["i"]["tags"] == ["x", "x", "y"]


@pytest.mark.parametrize(
    ("first", "second", "quality", "why", "n"),
    [
        (ev("none", "n"), ev("medium", "m", ("S", "1")), "medium", "m", 1),
        (ev("high", "h", ("S", "1")), ev("none", "n"), "high", "h", 1),
        (ev("low", "l", ("S", "1")), ev("high", "h", ("S", "1"), ("S", "2")), "high", "l h", 2),
        (ev("high", "h", ("S", "1")), ev("low", "h", ("T", "1")), "high", "h", 2),
        (ev("odd", "o"), ev("low", "l"), "low", "l", 0),
        (ev("none", "n"), ev("none", "m"), "none", "n", 0),
    ],
)
def test_evidence(spark, first, second, quality, why, n):
    got = merge(spark, [("i", 0, 0, "c", "", [], first), ("i", 1, 0, "c", "", [], second)])["i"]["evidence"]
    assert (got["quality"], got["rationale"], len(got["citations"])) == (quality, why, n)


def test_order_and_ids(spark):
    none = ev("none")
    rows = [("b", 0, 0, "first", "", [], none), ("a", 0, 1, "c", "", [], none), (None, 0, 2, "c", "", [], none), ("", 0, 3, "c", "", [], none), ("c", 1, 0, "c", "", [], none), ("b", 1, 1, "later", "", [], none)]
    got = merge(spark, rows)
    assert list(got) == ["b", "a", "c"] and got["b"]["category"] == "first"


def test_configuration():
    assert merging.merge_config("rrr_evidence_matrix").id_key == "solution_id"
    with pytest.raises(KeyError):
        merging.merge_config("nothing")
