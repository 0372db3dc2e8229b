"""Compiled schemas against a plain validator, on random values; asking in rounds, with a store and pauses."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evispark.plans import generation, schema

COMMON = {
    "$defs": {
        "Text": {"type": "string", "minLength": 1},
        "Note": {"type": "object", "additionalProperties": False, "required": ["q", "r"], "properties": {"q": {"enum": ["low", "high"]}, "r": {"$ref": "#/$defs/Text"}, "c": {"type": "array", "items": {"$ref": "#/$defs/Text"}}}},
        "None": {"type": "object", "additionalProperties": False, "required": ["q", "r"], "properties": {"q": {"const": "none"}, "r": {"$ref": "#/$defs/Text"}, "c": {"type": "array", "maxItems": 0}}},
    }
}
SCHEMA = {
    "$id": "s", "type": "object", "additionalProperties": False, "required": ["job", "xs"],
    "properties": {
        "job": {"const": "it's"}, "day": {"type": "string", "pattern": "^\\d{2}$"},
        "xs": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/X"}},
    },
    "$defs": {"X": {"type": "object", "required": ["e"], "properties": {
        "e": {"oneOf": [{"$ref": "common.json#/$defs/Note"}, {"$ref": "common.json#/$defs/None"}]}, "n": {"type": "number", "minimum": 0, "maximum": 9, "exclusiveMaximum": 9},
        "i": {"type": ["integer", "null"]}, "u": {"type": "array", "uniqueItems": True}, "m": {"type": "object", "additionalProperties": {"type": "boolean"}},
        "any": {"anyOf": [{"type": "string", "maxLength": 2}, {"const": [1, {"a": 2}]}]}, "not": {"not": {"enum": [1, "b", None, True]}},
        "if": {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"allOf": [{"type": "array"}, {"maxItems": 1}]}}}}},
}


def is_a(v, kind):
    if kind in ("number", "integer"):
        return isinstance(v, int | float) and not isinstance(v, bool) and (kind == "number" or v == int(v))
    return {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}[kind] is type(v)


def same(a, b):
    if is_a(a, "number") and is_a(b, "number"):
        return a == b
    return type(a) is type(b) and a == b


def resolve(ref, root):
    name, _, path = ref.partition("#")
    root = node = COMMON if name else root
    for step in path.strip("/").split("/"):
        node = node[step]
    return node, root


def plain(v, s, root, at=()):
    """Paths of violations."""
    holds = lambda t: not plain(v, t, root, at)
    out, wrong = [], lambda bad: [at] if bad else []
    for k, w in s.items():
        if k == "$ref":
            out += plain(v, *resolve(w, root), at)
        elif k == "type":
            out += wrong(not any(is_a(v, x) for x in ([w] if isinstance(w, str) else w)))
        elif k == "const":
            out += wrong(not same(v, w))
        elif k == "enum":
            out += wrong(not any(same(v, x) for x in w))
        elif k in ("minLength", "maxLength", "pattern") and isinstance(v, str):
            out += wrong({"minLength": lambda: len(v) < w, "maxLength": lambda: len(v) > w, "pattern": lambda: not re.search(w, v)}[k]())
        elif k in ("minimum", "maximum", "exclusiveMaximum") and is_a(v, "number"):
            out += wrong({"minimum": v < w if k == "minimum" else 0, "maximum": k == "maximum" and v > w, "exclusiveMaximum": k == "exclusiveMaximum" and v >= w}[k])
        elif k in ("minItems", "maxItems", "uniqueItems", "items") and isinstance(v, list):
            if k == "items":
                out += [e for i, x in enumerate(v) for e in plain(x, w, root, (*at, i))]
            else:
                out += wrong({"minItems": lambda: len(v) < w, "maxItems": lambda: len(v) > w, "uniqueItems": lambda: len({json.dumps(x, sort_keys=True) for x in v}) < len(v)}[k]())
        elif isinstance(v, dict) and k == "required":
            out += [at for x in w if x not in v]
        elif isinstance(v, dict) and k == "properties":
            out += [e for x in w if x in v for e in plain(v[x], w[x], root, (*at, x))]
        elif isinstance(v, dict) and k == "additionalProperties":
            other = [x for x in v if x not in s.get("properties", {})]
            out += wrong(w is False and other) if w is False else [e for x in other for e in plain(v[x], w, root, (*at, x))]
        elif k in ("anyOf", "oneOf"):
            n = sum(map(holds, w))
            out += wrong(n == 0 if k == "anyOf" else n != 1)
        elif k == "allOf":
            out += [e for t in w for e in plain(v, t, root, at)]
        elif k == "not":
            out += wrong(holds(w))
        elif k == "if":
            out += plain(v, s["then"] if holds(w) else s["else"], root, at)
    return out


def random_value(rnd, depth=0):
    if depth < 4 and rnd.random() < 0.35:
        return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    if depth < 4 and rnd.random() < 0.4:
        return {rnd.choice(["e", "q", "r", "c", "n", "job", "x.y"]): random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return rnd.choice(["", "a", "none", "low", "it's", "12", "1\n", "٣٤", 0, 1, 9, 2.5, 3.0, -1, True, False, None])


def random_output(rnd):
    if rnd.random() < 0.1:
        return random_value(rnd)
    one = lambda *good: rnd.choice([*good, random_value(rnd)])
    note = lambda: {k: v for k, v in {"q": one("low", "none"), "r": one("why"), "c": one([], ["s"]), "z": 1}.items() if rnd.random() < (0.9 if k != "z" else 0.1)}
    x = lambda: {k: v for k, v in {"e": one(note(), note()), "n": one(5, 8.5), "i": one(None, 4.0), "u": one([1, 2], [1, 1]), "m": one({"t": True}), "any": one("ab", [1, {"a": 2}]), "not": one(2, "b"), "if": one("ab", [1])}.items() if rnd.random() < 0.8}
    out = {"job": one("it's"), "day": one("12", "1\n"), "xs": one([x() for _ in range(rnd.randrange(13))]), "extra": 1}
    return {k: v for k, v in out.items() if rnd.random() < (0.9 if k != "extra" else 0.1)}


def test_paths_are_those_of_a_plain_validator(spark):
    rnd = random.Random(3)
    values = [random_output(rnd) for _ in range(400)] + [{"job": "it's", "day": d, "xs": [{"e": {"q": "low", "r": "why", "c": ["s"]}, "n": 3, "u": [1, "1"]}]} for d in ("12", "34\n", "x")]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "n int, json string").repartition(4)
    found = df.select("n", F.expr(schema.Schema(SCHEMA, {"common.json": COMMON}).violations("try_parse_json(json)")).alias("e"))
    got = {r["n"]: [e["path"] for e in r["e"]] for r in found.collect()}
    some = 0
    for n, v in enumerate(values):
        want = sorted(plain(v, SCHEMA, SCHEMA), key=list)
        some += len(want) == 0
        assert got[n] == ["$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path) for path in want], v
    assert some >= 2


@pytest.mark.parametrize("wrong", [{"contains": {}}, {"properties": {"a": {"$ref": "#"}}}, {"then": {}}])
def test_what_cant_be_compiled_is_an_error(wrong):
    with pytest.raises(ValueError):
        schema.Schema(wrong).violations("v")


def test_deep_citations_and_names_that_repeat(spark):
    deep = json.loads("[" * 60 + '{"source_title": "t", "locator": "l"}' + "]" * 60)
    rows = [(0, json.dumps(deep)), (1, '{"a": 1, "a": 2}'), (2, None), (3, '"text with [ and {"'), (4, "[]")]
    df = spark.createDataFrame(rows, "n int, json string")
    got = {r["n"]: r["problems"] for r in schema.with_problems(df, schema.Gate(strict=True)).collect()}
    assert got == {0: ["$" + "[0]" * 60 + ": no identifier of the source"], 1: ["$: not valid JSON"], 2: ["$: not valid JSON"], 3: [], 4: []}


def test_answers_in_rounds_are_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(prompt):
        import pathlib
        import uuid

        (pathlib.Path(str(calls)) / uuid.uuid4().hex).write_text(f"{time.time()} {prompt}")
        if "never" in prompt:
            return '{"b": 1}'
        return "no JSON" if "Problems" not in prompt and "late" in prompt else '{"a":\n 1}'

    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["x", "late", "never", "x", "y"])], "k int, prompt string")
    gate, asking = schema.Gate(schema.Schema({"required": ["a"]})), generation.Asking(store=str(tmp_path / "store"), wave=2)
    got = {r["k"]: r["json"] for r in generation.generate_all(prompts, provider, "k", gate, asking=asking).collect()}
    assert got == {"0": '{"a": 1}', "1": '{"a": 1}', "2": '{"b": 1}', "3": '{"a": 1}', "4": '{"a": 1}'}
    said = [p.read_text().split(" ", 1)[1].split("\n")[0] for p in calls.iterdir()]
    assert sorted(said) == ["late", "late", "never", "never", "never", "x", "y"]
    generation.generate_all(prompts, provider, "k", gate, asking=asking).collect()
    assert len(list(calls.iterdir())) == len(said)


def test_tasks_share_the_pause(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(prompt):
        import pathlib

        (pathlib.Path(str(calls)) / prompt).write_text(str(time.time()))
        return "{}"

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "k int, prompt string")
    generation.generate_all(prompts, provider, "k", asking=generation.Asking(pause=0.3, tasks=4)).collect()
    times = sorted(float(p.read_text()) for p in calls.iterdir())
    assert len(times) == 8 and times[-1] - times[0] >= 0.3 * 3
