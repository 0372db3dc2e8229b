"""Rules for outputs and citations: each rule is a predicate, a table of violations their union, valid means empty."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, is_iso_date, is_web_address, strip

#: Fixed: the fields that can identify a source, and the optional ones that are cleaned when blank.
IDENTIFIERS = ("source_id", "source_url", "reference", "doi", "isbn")
OPTIONAL = ("source_url", "doi", "isbn", "reference", "authors", "publisher", "source_type", "quote")
QUALITIES = ("none", "low", "medium", "high")


def required(x: Column) -> Column:
    return x.isNotNull()


def non_empty(x: Column) -> Column:
    """At least one character; white space counts."""
    return x.isNull() | (F.length(x) >= 1)


def const(x: Column, value) -> Column:
    return x.isNull() | (x == F.lit(value))


def enum(x: Column, values) -> Column:
    return x.isNull() | x.isin(*values)


def pattern(x: Column, regex: str) -> Column:
    return x.isNull() | F.rlike(x, F.lit(regex))


def between(x: Column, low, high) -> Column:
    return x.isNull() | x.between(low, high)


def items(x: Column, least: int = 0, most: int | None = None) -> Column:
    n = F.size(x)
    return x.isNull() | ((n >= least) & (F.lit(True) if most is None else n <= most))


def only_keys(json: Column, allowed) -> Column:
    """A JSON object without other fields."""
    keys = F.json_object_keys(json)
    return keys.isNull() | (F.size(F.array_except(keys, F.array(*(F.lit(k) for k in allowed)))) == 0)


def any_present(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, (x.isNotNull() for x in xs))


def evidence_union(evidence: Column) -> Column:
    """Either a note (low, medium or high) or no evidence (none, and then no citation): exactly one holds."""
    q, n = evidence["quality"], F.coalesce(F.size(evidence["citations"]), F.lit(0))
    note = q.isin("low", "medium", "high") & evidence["rationale"].isNotNull()
    nothing = (q == "none") & evidence["rationale"].isNotNull() & (n <= 0)
    return F.coalesce(note, F.lit(False)) != F.coalesce(nothing, F.lit(False))


def violations(df: DataFrame, rules: Mapping[str, Column], key: list[str]) -> DataFrame:
    """(key…, path): a row for each rule that a row breaks, in one pass. ``rules``: path and message -> predicate."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(path)) for path, ok in rules.items()))
    return df.select(*key, F.explode(F.array_compact(broken)).alias("path"))


def clean_citation(c: Column) -> Column:
    """A citation struct with blank optional fields, malformed dates and useless addresses as null."""
    fields = {f: F.when(~blank(c[f]), c[f]) for f in OPTIONAL}
    url = fields["source_url"]
    fields["source_url"] = F.when(url.startswith("http") & ~url.contains("example.com"), url)
    out = c
    for f, v in fields.items():
        out = out.withField(f, v)
    return out.withField("published_date", F.when(is_iso_date(c["published_date"]), c["published_date"]))


def clean_citations(citations: Column) -> Column:
    return F.transform(citations, clean_citation)


def identified(c: Mapping[str, Column] | Column) -> Column:
    """The strict rule: an id, a web address, a reference, a DOI or an ISBN that isn't blank."""
    return (
        ~blank(c["source_id"]) | is_web_address(strip(c["source_url"])) | ~blank(c["reference"]) | ~blank(c["doi"]) | ~blank(c["isbn"])
    )


def source_violations(citations: DataFrame, allowed: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Citations whose source isn't allowed."""
    return citations.join(allowed.select(source_id).distinct(), source_id, "left_anti")


def allowed_only(citations: DataFrame, allowed: DataFrame, source_id: str = "source_id") -> DataFrame:
    return citations.join(allowed.select(source_id).distinct(), source_id, "left_semi")


def allowed_ids(sources: DataFrame | None = None, listed: str | None = None, spark=None) -> DataFrame:
    """Ids that may be cited: those of a table of sources, or of a comma-separated list."""
    if listed is not None:
        ids = sorted({x.strip() for x in listed.split(",") if x.strip()})
        return spark.createDataFrame([(x,) for x in ids], "source_id string")
    return sources.where(F.coalesce("source_id", F.lit("")) != "").select("source_id").distinct()
