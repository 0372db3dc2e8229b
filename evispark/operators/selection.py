"""Selecting what fits a prompt: budgets, batches of sources, query texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

BUDGET = 80_000


def first_fit(rows: DataFrame, group: list[str], source: list[str], place: list[str], length: str, max_chars: int = BUDGET) -> DataFrame:
    """Of ``rows`` those that fit ``max_chars`` per group, by their lengths alone: a null length is none.

    If all of a group fits, all stays. Otherwise its sources, in the order of their columns, may each have what an
    equal share, or what the sources before have left, allows; a source's rows are tried in the order of ``place``, each
    stays if it still fits, later ones may. Room only shrinks, so of a source's rows of one length above zero only the
    first share / length can stay; empty ones always do. Only those candidates, whose number the budget bounds, go
    through the fold, which streams them: no group is gathered. Nulls are values like others. A budget of nothing
    keeps nothing.
    """
    if max_chars <= 0:
        return rows.where("false")
    key, n = [*group, *source], F.coalesce(F.col(length), F.lit(0)).cast("long")
    totals = rows.groupBy(*key).agg(F.sum(n).alias("__chars")).groupBy(*group).agg(F.sum("__chars").alias("__all"), F.floor(F.lit(max_chars) / F.count(F.lit(1))).alias("__share"))
    sized = _same_key(rows.withColumn("__n", n), totals, group)
    free = (F.col("__all") <= max_chars) | (F.col("__n") == 0)
    tight = sized.where(~free & (F.col("__n") <= F.col("__share")))
    nth = F.row_number().over(Window.partitionBy(*key, "__n").orderBy(*place))
    tight = tight.withColumn("__nth", nth).where(F.col("__nth") * F.col("__n") <= F.col("__share")).drop("__nth", "__all")
    columns, n_group, n_key = rows.columns, len(group), len(key)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, room = None, 0, 0
        for batch in batches:
            keep = []
            for *names, size, share in zip(*(batch[c] for c in (*(f"__k{i}" for i in range(n_key)), "__n", "__share")), strict=True):
                if at is None or at[:n_group] != names[:n_group]:
                    at, left = None, max_chars
                if at != names:
                    at, room = names, min(share, left)
                keep.append(size <= room)
                if keep[-1]:
                    left, room = left - size, room - size
            yield batch.loc[keep, columns]

    # names in the fold are texts that tell nulls from values, so that they compare as they are grouped
    shown = {f"__k{i}": F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(c))), F.lit("")) for i, c in enumerate(key)}
    dealt = tight.repartition(*group) if group else tight.coalesce(1)
    kept = dealt.sortWithinPartitions(*key, *place).withColumns(shown).mapInPandas(fold, rows.schema)
    return sized.where(free).select(*columns).unionByName(kept)


def _same_key(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``key``, nulls being equal; without a key each row meets the one row of ``right``."""
    if not key:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in key})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"__r_{k}"]) for k in key))
    return left.join(other, on, how).drop(*(f"__r_{k}" for k in key))


def trim_sources(sources: DataFrame, max_chars: int = BUDGET, group: list[str] | None = None, order: str = "pos") -> DataFrame:
    """sources (group…, order, source_id, snippets array) with snippets cut to ``max_chars`` per group by ``first_fit``.

    Tables come before other snippets where something is cut; where all fits nothing changes. Without a group all
    rows are one prompt. Sources, told apart by order and id, stay without snippets. Places and lengths alone are
    folded; the texts stay where they are and meet the kept places in a join.
    """
    group = group or []
    if max_chars <= 0:
        return sources.withColumn("snippets", F.slice("snippets", 1, 0))
    source = [order, *(["source_id"] if "source_id" in sources.columns else [])]
    sized = F.transform("snippets", lambda s, i: F.struct(F.when(s["type"] == "table", 0).otherwise(1).alias("__t"), i.alias("__i"), F.length(s["text"]).alias("__l")))
    rows = sources.select(*group, *source, F.inline_outer(sized))  # a source without snippets has its share too
    kept = first_fit(rows, group, source, ["__t", "__i"], "__l", max_chars)
    kept = kept.where(F.col("__i").isNotNull()).groupBy(*group, *source).agg(F.array_sort(F.collect_list(F.struct("__t", "__i"))).alias("__kept"))  # what fits, and empty ones
    joined = _same_key(sources, kept, [*group, *source], "left")
    total = rows.groupBy(*group).agg(F.coalesce(F.sum("__l"), F.lit(0)).alias("__all"))
    joined = _same_key(joined, total, group, "left")
    cut = F.coalesce(F.transform("__kept", lambda k: F.get(F.col("snippets"), k["__i"])), F.slice("snippets", 1, 0))
    return joined.withColumn("snippets", F.when(F.col("__all") > max_chars, cut).otherwise(F.col("snippets"))).select(*sources.columns)


def source_batches(sources: DataFrame, most: int = 10_000) -> DataFrame:
    """(batch, …): each source with snippets is a batch of its own, together with all sources without any.

    ``batch`` is the id of the source with snippets. Sources without snippets are counted before they are broadcast.
    """
    full = sources.where(F.size("snippets") > 0)
    bare = sources.where(F.coalesce(F.size("snippets"), F.lit(0)) <= 0)
    few = bare.limit(most + 1).count() <= most
    heads = full.select(F.col("source_id").alias("batch"))
    return full.withColumn("batch", F.col("source_id")).unionByName(heads.crossJoin(F.broadcast(bare) if few else bare))


def generic_mechanism(m: Column) -> Column:
    """Blank, or a placeholder."""
    return (strip(F.coalesce(m, F.lit(""))) == "") | F.rlike(F.lower(m), F.lit("to be determined|placeholder|tbd"))


def solution_query(solution: Column, mechanism: Column) -> Column:
    return F.when(generic_mechanism(mechanism), solution).otherwise(F.concat(solution, F.lit(" — "), mechanism))


def item_query(lead: Column, head: Column, detail: Column) -> Column:
    return F.concat(lead, F.lit(": "), head, F.lit(" — "), detail)


def domain_query(domain: Column) -> Column:
    return F.concat(F.lit("Learning domain: "), domain)


def benchmark_query(labels: Column) -> Column:
    return F.concat(F.lit("HRH benchmarking: "), F.array_join(labels, ", "))


def lookup_with_fallback(df: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str, out: str) -> DataFrame:
    """The name for a code, or the code itself. ``dim`` is joined; Spark broadcasts it if it is small."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(name).alias("__n"))
    return df.join(d, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce("__n", F.col(key).cast("string"))).drop("__k", "__n")
