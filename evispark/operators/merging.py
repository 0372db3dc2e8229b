"""Merging partial outputs: an N-way full outer join on item ids with an ordered fold per item.

The folds depend on order, so they are expressions over an item's array of parts in batch order: one shuffle by
item id. An item has at most one part per batch and position, so the arrays are short as a rule; where an item has very
many parts, a fold's time still grows with their number and size, not with its square: kept texts are listed and joined
once, arrays are told apart by hashing or sorting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: rank of evidence qualities; unknown ones count as none.
QUALITY = {"none": 0, "low": 1, "medium": 2, "high": 3}
ARRAY_FIELDS = ("tags", "risks", "dependencies", "key_questions")
CITATION_KEY = ("source_id", "locator", "source_title")


@dataclass(frozen=True)
class MergeConfig:
    array_key: str
    id_key: str
    text_keys: tuple[str, ...]


#: Fixed: which field holds each job's items, their ids, and the texts that are appended.
MERGE_CONFIG = {
    "phase1_discovery_qa": MergeConfig("questions", "question_id", ("answer",)),
    "rrr_evidence_matrix": MergeConfig("solutions", "solution_id", ("implementation_notes",)),
    "table2_root_cause_mapping": MergeConfig("framework_items", "item_id", ("definition",)),
    "table3_intervention_framework": MergeConfig("interventions", "intervention_id", ("implementation_notes",)),
    "benchmark_country_scoring": MergeConfig("countries", "country_name", ()),
    "country_learning_briefs": MergeConfig("domains", "domain_id", ("summary",)),
}


def merge_config(job_id: str) -> MergeConfig:
    if job_id not in MERGE_CONFIG:
        raise KeyError(f"no merge configuration for job {job_id!r}")
    return MERGE_CONFIG[job_id]


def quality_rank(q: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), q), F.lit(0))


def fold_text(parts: Column, separator: str = "\n\n") -> Column:
    """Texts in order: each that isn't empty and differs from what has accumulated is appended after the separator.

    What has accumulated starts with the first text, so only a text that is the first, or starts with it and the
    separator, can be the same. Without any such text all are joined at once; else they are folded one by one.
    """
    def one_by_one(filled: Column) -> Column:
        return F.aggregate(filled, F.lit(""), lambda acc, x: F.when(x == acc, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(separator), x)))

    def fold(filled: Column, first: Column) -> Column:
        rest = F.slice(filled, F.lit(2), F.greatest(F.size(filled), F.lit(1)))
        like = _let(F.concat(first, F.lit(separator)), lambda start: F.exists(rest, lambda x: (x == first) | F.startswith(x, start)))
        return F.when(F.coalesce(like, F.lit(False)), one_by_one(filled)).otherwise(F.array_join(filled, separator))

    return _let(F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False))), lambda filled: _let(F.get(filled, F.lit(0)), lambda first: fold(filled, first)))


def fold_strings(parts: Column) -> Column:
    """Arrays in order: what isn't there yet is added once; the first that isn't empty comes whole, repeats included."""
    none = F.expr("cast(array() as array<string>)")

    def fold(filled: Column) -> Column:
        first = F.coalesce(F.get(filled, F.lit(0)), none)
        return F.concat(first, F.array_except(F.flatten(F.slice(filled, F.lit(2), F.greatest(F.size(filled), F.lit(1)))), first))

    return _let(F.filter(parts, lambda x: F.coalesce(F.size(x), F.lit(0)) > 0), fold)


def fold_objects(parts: Column, element: str) -> Column:
    """Arrays of other things than texts in order: those that aren't there yet are added, with what repeats among them.

    Sorted, equal things stand together, those of the first array that has them in front: these stay, in their order.
    """
    none = F.expr("array()").cast(f"array<{element}>")
    placed = F.flatten(F.transform(parts, lambda p, i: F.transform(F.coalesce(p, none), lambda v, j: F.struct(v.alias("v"), i.alias("i"), j.alias("j")))))

    def kept(s: Column) -> Column:
        heads = F.transform(s, lambda x, n: F.when((n == 0) | ~F.get(s, n - 1)["v"].eqNullSafe(x["v"]), n).otherwise(-1))
        # the last head up to each place: steps of 1, 2, 4, ... places
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(s), F.lit(2)))).cast("int"))
        upto = F.aggregate(steps, heads, lambda h, k: F.transform(h, lambda y, n: F.greatest(y, F.coalesce(F.get(h, n - F.pow(F.lit(2), k).cast("int")), F.lit(-1)))))
        first = _let(upto, lambda h: F.filter(s, lambda x, n: F.get(s, F.get(h, n))["i"] == x["i"]))
        return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["v"].alias("v")))), lambda x: x["v"])

    return _let(F.array_sort(placed), kept)


def _citation_key(c: Column) -> Column:
    """One text for the fields that tell citations apart; missing fields count as ''."""
    return F.concat(*(F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in (F.coalesce(c[k], F.lit("")) for k in CITATION_KEY)))


def _let(x: Column, f) -> Column:
    """``f(x)``, with ``x`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def dedup_citations(citations: Column) -> Column:
    """The first of each (source_id, locator, source_title), in order; missing fields count as ''. By sorting, not pair by pair."""
    def firsts(s: Column) -> Column:
        new = F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"]))
        return F.array_sort(F.transform(new, lambda x: x["i"]))

    keyed = lambda c: F.array_sort(F.transform(c, lambda x, i: F.struct(_citation_key(x).alias("k"), i.alias("i"))))
    return _let(citations, lambda c: F.transform(_let(keyed(c), firsts), lambda i: F.get(c, i)))


def fold_evidence(parts: Column, citation_type: str) -> Column:
    """Evidence blocks (quality, rationale, citations) in order.

    A block without evidence changes nothing; a single one with evidence stays as it is; of several the first of
    the best quality gives it, rationales that differ from what has accumulated are joined by a blank, and
    citations are united once at the end. Without any, the first block stays.
    """
    evidence_type = f"struct<quality:string,rationale:string,citations:array<{citation_type}>>"
    no_citations = F.lit(None).cast(f"array<{citation_type}>")
    plain = F.transform(parts, lambda p: F.when(p.isNotNull(), F.struct(p["quality"].alias("quality"), p["rationale"].alias("rationale"), F.coalesce(p["citations"], no_citations).alias("citations")).cast(evidence_type)))

    def joined(some: Column) -> Column:
        best = F.aggregate(some, F.get(some, F.lit(0))["quality"], lambda q, x: F.when(quality_rank(x["quality"]) > quality_rank(q), x["quality"]).otherwise(q))
        first = F.get(some, F.lit(0))["rationale"]
        said = _let(fold_text(F.transform(some, lambda x: x["rationale"]), " "), lambda r: F.when(r == "", first).otherwise(r))
        cited = F.flatten(F.transform(some, lambda x: F.coalesce(x["citations"], F.array().cast(f"array<{citation_type}>"))))
        return F.struct(best.alias("quality"), said.alias("rationale"), dedup_citations(cited).alias("citations")).cast(evidence_type)

    def chosen(all_: Column) -> Column:
        some = F.filter(all_, lambda x: F.coalesce(quality_rank(x["quality"]) > 0, F.lit(False)))
        return _let(some, lambda s: F.when(F.size(s) > 1, joined(s)).when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(F.get(F.filter(all_, lambda x: x.isNotNull()), F.lit(0))))

    return _let(plain, chosen)


def merge_items(
    parts: DataFrame, id_col: str, text_cols: tuple[str, ...] = (), array_cols: tuple[str, ...] = (), evidence_col: str | None = None,
    group: tuple[str, ...] = (), batch: str = "batch", pos: str = "pos",
) -> DataFrame:
    """One row per item (within ``group``): texts, arrays and evidence folded in (batch, pos) order, other fields from its first part.

    Parts without an id are dropped. ``item_order`` numbers the items of a group as the first batch has them, then
    as they first appear: a struct (batch, pos) to sort by. Of equal (batch, pos) the smaller values come first. Only
    parts that add something are gathered, and nothing is where there is nothing to fold.
    """
    rest = [c for c in parts.columns if c not in (*group, id_col, *text_cols, *array_cols, evidence_col, batch, pos)]
    rows, at = parts.where(F.col(id_col).isNotNull() & (F.col(id_col) != "")), F.struct(batch, pos)
    held = {c: F.col(c) != "" for c in text_cols} | {c: F.size(c) > 0 for c in array_cols} | ({evidence_col: F.col(evidence_col).isNotNull()} if evidence_col else {})
    gathered = [F.sort_array(F.collect_list(F.when(some, F.struct(batch, pos, F.col(c).alias("v"))))).alias(c) for c, some in held.items()]
    firsts = [F.min_by(F.struct(*rest), F.struct(batch, pos, *rest)).alias("__rest")] if rest else []
    grouped = rows.groupBy(*group, id_col).agg(F.min(at.cast(_order_type(parts, batch, pos))).alias("item_order"), *gathered, *firsts)
    each = lambda c: F.transform(c, lambda p: p["v"])
    out = [*group, id_col, "item_order"]
    out += [fold_text(each(c)).alias(c) for c in text_cols]
    element = lambda c: parts.schema[c].dataType.elementType.simpleString()
    out += [(fold_strings(each(c)) if element(c) == "string" else fold_objects(each(c), element(c))).alias(c) for c in array_cols]
    if evidence_col:
        citation = parts.schema[evidence_col].dataType["citations"].dataType.elementType.simpleString()
        out.append(fold_evidence(each(evidence_col), citation).alias(evidence_col))
    out += [F.col("__rest")[c].alias(c) for c in rest]
    return grouped.select(*out)


def _order_type(parts: DataFrame, batch: str, pos: str) -> str:
    return f"struct<batch:{parts.schema[batch].dataType.simpleString()},pos:{parts.schema[pos].dataType.simpleString()}>"


def latest_per_group(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row with the latest time of each key; of equal times that with the greatest ``tie``.

    Combined before the shuffle. Every column of ``df`` travels: select what is needed first.
    """
    value = F.struct(*(c for c in df.columns if c not in keys))
    best = df.groupBy(*keys).agg(F.max_by(value, F.struct(time, tie)).alias("__v"))
    return best.select(*keys, "__v.*")


def first_citations(citations: DataFrame, order: str, keys: tuple[str, ...] = CITATION_KEY) -> DataFrame:
    """Citations in a table: the first of each key by ``order``; missing key fields count as ''."""
    rows = citations.withColumns({f"__k{i}": F.coalesce(k, F.lit("")) for i, k in enumerate(keys)})
    best = rows.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*citations.columns), order).alias("__v"))
    return best.select("__v.*")
