"""The budget of a prompt: cut sources against a plain loop; prompts of many batches in one plan."""

import json
import random

import pytest

from evispark.operators import selection
from evispark.plans import prompts

KIND = "g string, pos int, source_id string, snippets array<struct<text:string,type:string,locator:string>>, extra int"


def plain(sources, limit):
    if limit <= 0:
        return [[] for _ in sources]
    if sum(len(t or "") for _, ss in sources for t, _, _ in ss or []) <= limit:
        return [ss for _, ss in sources]
    out, left = [], limit
    for _, ss in sources:
        kept, used, room = [], 0, min(limit // len(sources), left)
        for s in sorted(ss or [], key=lambda s: s[1] != "table"):
            if used + len(s[0] or "") <= room:
                kept.append(s)
                used += len(s[0] or "")
        left -= used
        out.append(kept)
    return out


@pytest.mark.parametrize("limit", [0, 7, 40, 10_000])
def test_sources_are_cut_as_a_plain_loop_does(spark, limit):
    rnd = random.Random(limit)
    groups = {g: [(i, [("x" * rnd.choice([0, 1, 3, 5, 9, 50]), rnd.choice(["table", "text"]), f"{i}.{j}") for j in range(rnd.randrange(6))]) for i in range(n)] for g, n in [("a", 5), (None, 3), ("b", 1), ("c", 12)]}
    rows = [(g, i, f"S{i}", ss, 1) for g, sources in groups.items() for i, ss in sources]
    got = selection.trim_sources(spark.createDataFrame(rows, KIND).repartition(3), limit, ["g"])
    assert got.columns == ["g", "pos", "source_id", "snippets", "extra"]
    found = {(r["g"], r["pos"]): [tuple(s) for s in r["snippets"]] for r in got.collect()}
    assert found == {(g, i): kept for g, sources in groups.items() for (i, _), kept in zip(sources, plain(sources, limit), strict=True)}


def test_null_snippets_and_texts(spark):
    df = spark.createDataFrame([("g", 0, "A", None, 1), ("g", 1, "B", [(None, "text", "l"), ("xxxxx", None, "m")], 1), ("g", None, "C", [("xxx", "text", "l")], 1)], KIND)
    got = {r["source_id"]: r["snippets"] for r in selection.trim_sources(df, 100).collect()}
    assert got["A"] is None and len(got["B"]) == 2
    got = {r["source_id"]: r["snippets"] for r in selection.trim_sources(df, 7).collect()}
    assert [len(got[s] or []) for s in "ABC"] == [0, 1, 0]
    assert selection.trim_sources(df.where("false"), 7).collect() == []


def test_a_prompt_per_batch_without_a_plan_per_batch(spark):
    specs = spark.createDataFrame([("s", json.dumps({"questions": [{"id": "a", "text": "One?"}]}))], "spec_id string, json string")
    kind = "source_id string, source_title string, pos int, snippets array<struct<text:string,type:string>>"
    sources = spark.createDataFrame([(f"S{i}", "t", i, [(f"text {i}", "text")] if i else []) for i in range(40)], kind)
    made = prompts.job_prompt(specs, "T", "phase1_discovery_qa", "Land", sources=selection.source_batches(sources), batch="batch")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") < 15  # however many batches
    got = {r["batch"]: r["prompt"] for r in made.collect()}
    assert len(got) == 39 and all(f"text {b[1:]}\"" in p and '"S0"' in p and p.count("source_title") == 2 for b, p in got.items())
