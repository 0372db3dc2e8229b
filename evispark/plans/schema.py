"""Outputs against closed schema documents: a schema is compiled into one expression over VARIANT.

The subset of JSON Schema 2020-12 that is compiled: see ``KEYWORDS``. References are resolved when compiling; an unknown
keyword or a schema that refers to itself is an error then, never a rule that is passed over. The expression gives every
violation of an output with its path, on the JVM, in the order of the paths. It is composed as SQL text, which Spark
parses at once: a schema has thousands of nodes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CHARS

#: Fixed: keywords that say nothing about what is valid.
NOTES = ("$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly")
#: Digits of a place in an array, in the key that paths are sorted by; its steps are parted by the least character.
DIGITS = 10
NONE = "cast(array() as array<struct<key:string,path:string,message:string>>)"
#: Objects and arrays in one another that are looked into for citations.
DEEPEST = 1000

_names = count()


def _text(x) -> str:
    """A constant text in SQL."""
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def _each(array: str, f: Callable[[str], str], how: str = "transform") -> str:
    name = f"x{next(_names)}"
    return f"{how}({array}, {name} -> {f(name)})"


def _let(x: str, f: Callable[[str], str]) -> str:
    """``f(x)``, with ``x`` computed once however often ``f`` uses it."""
    return f"get({_each(f'array({x})', f)}, 0)"


def _map(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _array(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


@dataclass(frozen=True)
class _Value:
    """A value within an output, bound to a name: v, its members m, its elements a (null if it has none), key, path."""

    x: str

    @property
    def m(self) -> str:
        return f"{self.x}.m"

    @property
    def a(self) -> str:
        return f"{self.x}.a"

    @property
    def text(self) -> str:
        return f"variant_get({self.x}.v, '$', 'string')"

    @property
    def number(self) -> str:
        return f"variant_get({self.x}.v, '$', 'double')"

    def is_a(self, kind: str) -> str:
        v = f"{self.x}.v"
        of = {
            "object": f"{self.m} IS NOT NULL", "array": f"{self.a} IS NOT NULL", "null": f"is_variant_null({v})",
            "string": f"schema_of_variant({v}) = 'STRING'", "boolean": f"schema_of_variant({v}) = 'BOOLEAN'",
            "number": f"schema_of_variant({v}) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'",
        }
        return f"({of['number']} AND floor({self.number}) = {self.number})" if kind == "integer" else f"({of[kind]})"

    def violation(self, message: str) -> str:
        return f"named_struct('key', {self.x}.key, 'path', {self.x}.path, 'message', {message})"

    def wrong(self, broken: str, message: str) -> str:
        """One violation if ``broken`` holds; ``message`` is SQL."""
        return f"if({broken}, array({self.violation(message)}), {NONE})"

    def shown(self, message: str) -> str:
        return f"concat(to_json({self.x}.v), {_text(message)})"

    def child(self, v: str, step: str, name: str, check: Callable[[_Value], str]) -> str:
        return _value(v, f"concat({self.x}.key, char(0), {step})", f"concat({self.x}.path, {name})", check)


def _value(v: str, key: str, path: str, check: Callable[[_Value], str]) -> str:
    """``check`` of a value; nothing if there is none."""
    bound = f"named_struct('v', {v}, 'm', {_map(v)}, 'a', {_array(v)}, 'key', {key}, 'path', {path})"
    return f"if({v} IS NULL, {NONE}, {_let(bound, lambda x: check(_Value(x)))})"


def _equals(x: _Value, wanted) -> str:
    if isinstance(wanted, str):
        return f"({x.is_a('string')} AND {x.text} = {_text(wanted)})"
    if isinstance(wanted, bool):
        return f"({x.is_a('boolean')} AND {x.text} = '{str(wanted).lower()}')"
    if wanted is None:
        return x.is_a("null")
    if isinstance(wanted, int | float):
        return f"({x.is_a('number')} AND {x.number} = {float(wanted)!r}D)"
    return f"(to_json({x.x}.v) = to_json(parse_json({_text(_json(wanted))})))"


class Schema:
    """A schema with the documents it refers to, by name. ``format`` isn't enforced."""

    def __init__(self, schema: dict, others: dict[str, dict] | None = None) -> None:
        self.schema, self.others = schema, others or {}

    def _resolve(self, ref: str, root: dict) -> tuple[dict, dict]:
        name, _, path = ref.partition("#")
        if name:
            root = next(v for k, v in self.others.items() if k.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1])
        node = root
        for step in filter(None, path.split("/")):
            node = node[step.replace("~1", "/").replace("~0", "~")]
        return node, root

    def violations(self, v: str) -> str:
        """Every violation of the variant column ``v``, in SQL: an array of (key, path, message), sorted by path."""
        found = _value(v, "''", "'$'", lambda x: self._check(x, self.schema, self.schema, ()))
        return f"array_sort({found}, (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"

    def _check(self, x: _Value, s: dict | bool, root: dict, open_: tuple) -> str:
        if isinstance(s, bool):
            return NONE if s else x.wrong("true", "'nothing is allowed here'")
        if id(s) in open_:
            raise ValueError("a schema that refers to itself can't be compiled")
        found = []
        for word, wanted in s.items():
            if word == "$ref":
                found.append(self._check(x, *self._resolve(wanted, root), (*open_, id(s))))
            elif word in KEYWORDS:
                found += KEYWORDS[word](x, wanted, lambda y, t: self._check(y, t, root, (*open_, id(s))), s)
            elif word not in NOTES and not ("if" in s and word in ("then", "else")):
                raise ValueError(f"unknown keyword {word!r}")
        return f"concat({', '.join(found)})" if found else NONE


Check = Callable[[_Value, "dict | bool"], str]


def _type(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    kinds = [wanted] if isinstance(wanted, str) else wanted
    return [x.wrong(f"NOT ({' OR '.join(map(x.is_a, kinds))})", x.shown(f" is not of type {', '.join(kinds)}"))]


def _const(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    return [x.wrong(f"NOT {_equals(x, wanted)}", _text(f"{_json(wanted)} was expected"))]


def _enum(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    return [x.wrong(f"NOT ({' OR '.join(_equals(x, w) for w in wanted)})", x.shown(f" is not one of {_json(wanted)}"))]


def _of(kind: str, holds: str, message: str):
    """A keyword on values of a kind. In ``holds`` {x} is the text, number or things of the value and {n} the keyword's value."""
    def check(x: _Value, wanted, check: Check, s: dict) -> list[str]:
        of = {"string": x.text, "number": x.number, "array": x.a, "object": x.m}[kind]
        said = x.shown(f" {message} {wanted}") if kind in ("string", "number") else _text(f"{message} {wanted}")
        return [x.wrong(f"{x.is_a(kind)} AND NOT ({holds.format(x=of, n=_text('(?Ud)' + wanted) if isinstance(wanted, str) else repr(wanted))})", said)]

    return check


def _required(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    names = ", ".join(map(_text, wanted))
    missing = _each(f"array_except(array({names}), map_keys({x.m}))", lambda k: x.violation(f"concat('\\'', {k}, '\\' is a required property')"))
    return [f"if({x.is_a('object')}, {missing}, {NONE})"] if wanted else []


def _properties(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    found = [x.child(f"try_element_at({x.m}, {_text(k)})", _text(k), _text(f".{k}"), lambda y, t=t: check(y, t)) for k, t in wanted.items()]
    return [f"if({x.is_a('object')}, concat({', '.join(found)}), {NONE})"] if found else []


def _additional(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    known = ", ".join(map(_text, s.get("properties", {})))
    other = f"array_sort(array_except(map_keys({x.m}), cast(array({known}) as array<string>)))"
    if wanted is False:
        return [x.wrong(f"{x.is_a('object')} AND size({other}) > 0", f"concat('additional properties: ', array_join({other}, ', '))")]
    one = lambda k: x.child(f"try_element_at({x.m}, {k})", k, f"concat('.', {k})", lambda y: check(y, wanted))
    return [f"if({x.is_a('object')}, flatten({_each(other, one)}), {NONE})"]


def _items(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    name = f"x{next(_names)}"
    one = x.child(name, f"lpad(i{name}, {DIGITS}, '0')", f"concat('[', i{name}, ']')", lambda y: check(y, wanted))
    return [f"if({x.is_a('array')}, flatten(transform({x.a}, ({name}, i{name}) -> {one})), {NONE})"]


def _unique(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    texts = _each(x.a, lambda v: f"to_json({v})")
    return [x.wrong(f"{x.is_a('array')} AND size(array_distinct({texts})) < size({x.a})", "'elements repeat'")] if wanted else []


def _held(x: _Value, schemas: list, check: Check) -> str:
    """How many of the schemas hold."""
    return " + ".join(f"if(size({check(x, t)}) = 0, 1, 0)" for t in schemas)


def _any(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    return [x.wrong(f"({_held(x, wanted, check)}) = 0", "'not valid under any of the given schemas'")]


def _one(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    said = lambda n: f"if({n} = 0, 'not valid under any of the given schemas', 'valid under more than one of the given schemas')"
    return [_let(_held(x, wanted, check), lambda n: x.wrong(f"{n} <> 1", said(n)))]


def _all(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    return [check(x, t) for t in wanted]


def _not(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    return [x.wrong(f"size({check(x, wanted)}) = 0", "'valid under a schema that must not hold'")]


def _if(x: _Value, wanted, check: Check, s: dict) -> list[str]:
    then, otherwise = (check(x, s[w]) if w in s else NONE for w in ("then", "else"))
    return [f"if(size({check(x, wanted)}) = 0, {then}, {otherwise})"]


#: What is compiled: keyword -> violations of a value. Patterns are read as Unicode ones that know ``\\n`` as the only line end.
KEYWORDS: dict[str, Callable[[_Value, object, Check, dict], list[str]]] = {
    "type": _type, "const": _const, "enum": _enum, "properties": _properties, "required": _required, "additionalProperties": _additional,
    "items": _items, "uniqueItems": _unique, "anyOf": _any, "oneOf": _one, "allOf": _all, "not": _not, "if": _if,
    "pattern": _of("string", "{x} RLIKE {n}", "does not match"),
    "minLength": _of("string", "length({x}) >= {n}", "is shorter than"), "maxLength": _of("string", "length({x}) <= {n}", "is longer than"),
    "minimum": _of("number", "{x} >= {n}", "is less than"), "maximum": _of("number", "{x} <= {n}", "is greater than"),
    "exclusiveMinimum": _of("number", "{x} > {n}", "is not greater than"), "exclusiveMaximum": _of("number", "{x} < {n}", "is not less than"),
    "minItems": _of("array", "size({x}) >= {n}", "fewer items than"), "maxItems": _of("array", "size({x}) <= {n}", "more items than"),
    "minProperties": _of("object", "size({x}) >= {n}", "fewer properties than"), "maxProperties": _of("object", "size({x}) <= {n}", "more properties than"),
}


def load(path: str) -> Schema:
    """The schema document at ``path``, which may refer to those beside it."""
    def read(name: str) -> dict:
        with open(name, encoding="utf-8") as f:
            return json.load(f)

    def beside(folder: str) -> Iterator[tuple[str, dict]]:
        for n in sorted(os.listdir(folder)):
            if n.endswith(".schema.json") or n == "common.json":
                yield n, read(os.path.join(folder, n))

    return Schema(read(path), dict(beside(os.path.dirname(os.path.abspath(path)))))


def _children(x: str) -> str:
    """(key, path, v) of what an object or array has; nothing of other values."""
    name = f"x{next(_names)}"
    entry = lambda key, path, v: f"named_struct('key', concat({x}.key, char(0), {key}), 'path', concat({x}.path, {path}), 'v', {v})"
    members = _each(f"map_entries({_map(f'{x}.v')})", lambda e: entry(f"{e}.key", f"concat('.', {e}.key)", f"{e}.value"))
    elements = f"transform({_array(f'{x}.v')}, ({name}, i{name}) -> {entry(f'lpad(i{name}, {DIGITS}, \'0\')', f'concat(\'[\', i{name}, \']\')', name)})"
    return f"coalesce({members}, {elements}, cast(array() as array<struct<key:string,path:string,v:variant>>))"


def citations(v: str) -> str:
    """Every object of the variant column ``v`` with a title and a locator, at any depth: (key, path, v), outer ones first.

    Looked into level by level, as many levels as there can be: the expression has one size whatever the depth.
    """
    cited = lambda x: _let(_map(f"{x}.v"), lambda m: f"coalesce(map_contains_key({m}, 'source_title') AND map_contains_key({m}, 'locator'), false)")
    top = f"array(named_struct('key', '', 'path', '$', 'v', {v}))"
    below = lambda level: f"flatten({_each(level, _children)})"
    step = _let(below("s.level"), lambda b: f"named_struct('found', concat(s.found, {_each(b, cited, 'filter')}), 'level', {b})")
    levels = f"sequence(1, greatest(1, least({DEEPEST}, length(regexp_replace(to_json({v}), '[^\\\\[{{]', '')))))"
    return f"aggregate({levels}, named_struct('found', {_each(top, cited, 'filter')}, 'level', {top}), (s, i) -> if(size(s.level) > 0, {step}, s), s -> s.found)"


#: Fixed: what can identify a source besides its address.
NAMED_BY = ("source_id", "reference", "doi", "isbn")


def _field(c: str, name: str) -> str:
    """The text of a citation's field; null if it isn't a text."""
    return f"if(schema_of_variant(variant_get({c}, '$.{name}')) = 'STRING', variant_get({c}, '$.{name}', 'string'), null)"


def _identified(c: str) -> str:
    stripped = lambda k: f"trim(BOTH {_text(SPACE_CHARS)} FROM {_field(c, k)})"
    named = [f"coalesce({stripped(k)} <> '', false)" for k in NAMED_BY]
    return f"({' OR '.join(named)} OR coalesce({stripped('source_url')} RLIKE '^https?://[^/?#]+', false))"


@dataclass(frozen=True)
class Gate:
    """What an output must hold: a schema; with ``strict`` citations that name their source; with ``allowed`` only these sources.

    The rules on citations are looked at once the schema holds. Without anything given, every output holds.
    """

    schema: Schema | None = None
    strict: bool = False
    allowed: frozenset[str] = frozenset()

    def __bool__(self) -> bool:
        return bool(self.schema or self.strict or self.allowed)

    def problems(self, v: str) -> str:
        """``path: message`` of everything wrong with the variant column ``v``, in SQL."""
        lines = lambda found: _each(found, lambda e: f"concat({e}.path, ': ', {e}.message)")
        wrong = lines(self.schema.violations(v)) if self.schema else "cast(array() as array<string>)"
        if self.strict:
            wrong = self._next(wrong, v, lambda c: f"NOT {_identified(c)}", lambda c: "'no identifier of the source'")
        if self.allowed:
            listed = ", ".join(map(_text, sorted(self.allowed)))
            source = lambda c: _field(c, "source_id")
            wrong = self._next(wrong, v, lambda c: f"NOT coalesce({source(c)} IN ({listed}), false)", lambda c: f"concat('source ', coalesce({source(c)}, '(none)'), ' is not allowed')")
        return wrong

    @staticmethod
    def _next(wrong: str, v: str, broken: Callable[[str], str], message: Callable[[str], str]) -> str:
        broken_ones = _each(citations(v), lambda x: broken(f"{x}.v"), "filter")
        found = _each(broken_ones, lambda x: f"concat({x}.path, ': ', {message(f'{x}.v')})")
        return _let(wrong, lambda w: f"if(size({w}) > 0, {w}, {found})")


def with_problems(outputs: DataFrame, gate: Gate, json_col: str = "json", name: str = "problems") -> DataFrame:
    """Adds ``problems``: an array of texts, empty if all holds. What isn't JSON, or has a name twice in an object, is one problem."""
    rows = outputs.withColumn("__v", F.try_parse_json(F.col(f"`{json_col}`")))
    return rows.withColumn(name, F.when(F.col("__v").isNull(), F.array(F.lit("$: not valid JSON"))).otherwise(F.expr(gate.problems("__v")))).drop("__v")


def output_errors(outputs: DataFrame, gate: Gate, key: tuple[str, ...] = (), json_col: str = "json") -> DataFrame:
    """(key…, error): a row per problem of each output."""
    rows = with_problems(outputs.select(*key, json_col), gate, json_col, "__problems")
    return rows.select(*key, F.explode("__problems").alias("error"))


def schema_errors(outputs: DataFrame, schema: dict, others: dict[str, dict] | None = None, key: tuple[str, ...] = (), json_col: str = "json") -> DataFrame:
    """``output_errors`` against a closed schema document."""
    return output_errors(outputs, Gate(Schema(schema, others)), key, json_col)
