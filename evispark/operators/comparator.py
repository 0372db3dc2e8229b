"""Comparator index: standardised, weighted distance of entities from a target; nearest and outperforming peers.

All of it is expressions and one-row aggregates: the target's row and the column statistics have one row by
construction and are broadcast; entities are never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Fixed names: indicators and peer attributes of the published index, and which way is better.
INDICATORS = ("GDP", "Population", "Urban Pop", "MMR", "U5M", "NMR", "CPR", "TFR", "PHC")
PEER_COLUMNS = ("Income group", "Region", "CHP", "Types of CHW")
LOWER_BETTER = ("MMR", "U5M", "NMR", "TFR")
HIGHER_BETTER = ("CPR", "PHC")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Column names with runs of white space as one blank, trimmed."""
    return df.toDF(*(re.sub(r"\s+", " ", c).strip() for c in df.columns))


def to_number(x: Column) -> Column:
    """As a double; what isn't a number, and NaN, is null."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError("none of the indicators is a column")
    return found


def coerce(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def drop_sparse(df: DataFrame, columns: list[str], share: float = 0.25, least: int = 2) -> DataFrame:
    """Rows with at most max(least, share of the columns) missing values; adds ``_missing_n``."""
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return df.withColumn("_missing_n", missing).where(F.col("_missing_n") <= max(least, int(share * len(columns))))


def _key(x: Column) -> Column:
    return F.lower(F.trim(x))


def target_row(df: DataFrame, target: str, name: str = "Country") -> DataFrame:
    """The one row whose trimmed, lower-cased name is the target's, as a local table; an error otherwise."""
    found = df.where(_key(F.col(f"`{name}`")) == target.strip().lower()).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"target {target!r} must match exactly one row")
    return df.sparkSession.createDataFrame(found, df.schema)


def peers(df: DataFrame, target: DataFrame, columns: Iterable[str], name: str = "Country") -> DataFrame:
    """Rows other than the target that agree with it in every peer column where it has a value."""
    have = [c for c in columns if c in df.columns]
    t = target.select(F.col(f"`{name}`").alias("__t"), *(F.col(f"`{c}`").cast("string").alias(f"__t{i}") for i, c in enumerate(have)))
    agree = _key(F.col(f"`{name}`")) != _key(F.col("__t"))
    for i, c in enumerate(have):
        mine = F.coalesce(F.trim(F.col(f"__t{i}")), F.lit(""))
        agree &= (mine == "") | F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) == mine, F.lit(False))
    return df.crossJoin(F.broadcast(t)).where(agree).drop("__t", *(f"__t{i}" for i in range(len(have))))  # one row


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, nulls skipped."""
    return df.agg(*(f(F.col(f"`{c}`")).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))))


def standardise(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``z_<column>``; 0 for all rows where there is no spread."""
    z = {}
    for i, c in enumerate(columns):
        s = F.col(f"__s{i}")
        flat = s.isNull() | F.isnan(s) | (s == 0)
        z[f"z_{c}"] = F.when(flat, 0.0).otherwise((F.col(f"`{c}`") - F.col(f"__m{i}")) / s)
    return df.crossJoin(F.broadcast(stats)).withColumns(z).drop(*(f"__{k}{i}" for i in range(len(columns)) for k in "ms"))  # one row


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``z_<column>``: population z-scores that skip nulls; 0 for all rows where there is no spread. ``df`` is computed once."""
    df = written(df)
    return standardise(df, column_stats(df, columns), columns)


def parse_weights(text: str | Mapping[str, float] | None, columns: list[str]) -> dict[str, float]:
    """``a=2,b=0.5`` as weights by column; unknown names are ignored, missing ones weigh 1."""
    given = {}
    if isinstance(text, Mapping):
        given = dict(text)
    elif text:
        for part in text.split(","):
            k, eq, v = part.partition("=")
            if eq:
                given[k.strip()] = float(v)
    return {c: float(given.get(c, 1.0)) for c in columns}


def distances(df: DataFrame, target: DataFrame, columns: list[str], weights: Mapping[str, float]) -> DataFrame:
    """Adds ``distance`` from the target over z columns; a column missing on either side adds nothing."""
    t = target.select(*(F.col(f"`z_{c}`").alias(f"__z{i}") for i, c in enumerate(columns)))
    terms = [F.coalesce(F.lit(weights[c]) * F.pow(F.col(f"`z_{c}`") - F.col(f"__z{i}"), 2), F.lit(0.0)) for i, c in enumerate(columns)]
    out = df.crossJoin(F.broadcast(t))  # one row
    return out.withColumn("distance", F.sqrt(sum(terms[1:], terms[0]))).drop(*(f"__z{i}" for i in range(len(columns))))


def better_count(df: DataFrame, target: DataFrame, lower: Iterable[str], higher: Iterable[str]) -> DataFrame:
    """Adds ``better_count``: in how many indicators a row is strictly better than the target."""
    low, high = [c for c in lower if c in df.columns], [c for c in higher if c in df.columns]
    t = target.select(*(F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(low + high)))
    better = [F.col(f"`{c}`") < F.col(f"__b{i}") for i, c in enumerate(low)]
    better += [F.col(f"`{c}`") > F.col(f"__b{i + len(low)}") for i, c in enumerate(high)]
    n = sum((F.coalesce(b.cast("int"), F.lit(0)) for b in better), F.lit(0))
    return df.crossJoin(F.broadcast(t)).withColumn("better_count", n).drop(*(f"__b{i}" for i in range(len(low + high))))  # one row


def score(
    df: DataFrame, target: str, columns: list[str], peer_columns: Iterable[str] = (), weights: str | Mapping[str, float] | None = None, name: str = "Country"
) -> tuple[DataFrame, DataFrame]:
    """(scored candidates, target with z columns). z-scores are over the candidates and the target. ``df`` is computed once."""
    df = written(df)
    t = target_row(df, target, name)
    rest = peers(df, t, peer_columns, name)
    stats = column_stats(rest.unionByName(t), columns)
    zt = standardise(t, stats, columns)
    return distances(standardise(rest, stats, columns), zt, columns, parse_weights(weights, columns)), zt


def nearest(scored: DataFrame, k: int = 20, name: str = "Country") -> DataFrame:
    """The k nearest; ties by name."""
    return scored.orderBy("distance", name).limit(k)


#: So many nearest rows are sorted in one place.
SORTED = 50_000


def _nearest_share(scored: DataFrame, pool: float, least: int, name: str) -> DataFrame:
    """The nearest ``pool`` share of the rows (``least`` at least), ties by name.

    Where they are more than one task should sort, approximate quantiles bracket the last distance that counts; only
    the rows in the bracket, a few thousandths of all, are ranked exactly.
    """
    total = scored.count()
    n, error = max(int(pool * total), least), 0.001
    if n <= SORTED:
        return scored.orderBy("distance", name).limit(n)
    if n >= total:
        return scored
    share = n / total
    low, high = scored.approxQuantile("distance", [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], error)
    surely = scored.where(F.col("distance") < low)
    rest = scored.where(F.col("distance").between(low, high)).orderBy("distance", name).limit(n - surely.count())
    return surely.unionByName(rest)


def aspirational(
    scored: DataFrame, target: DataFrame, k: int = 20, lower: Iterable[str] = LOWER_BETTER, higher: Iterable[str] = HIGHER_BETTER,
    pool: float = 0.5, least: int = 3, name: str = "Country",
) -> DataFrame:
    """Of the nearest ``pool`` share (3 k at least), those better in ``least`` indicators or more; best first."""
    near = _nearest_share(scored, pool, 3 * k, name)
    found = better_count(near, target, lower, higher).where(F.col("better_count") >= least)
    return found.orderBy(F.desc("better_count"), "distance", name).limit(k)


def comparator_index(
    df: DataFrame, target: str, k: int = 20, aspirational_k: int = 20, peer_columns: Iterable[str] = PEER_COLUMNS,
    weights: str | None = None, indicators: Iterable[str] = INDICATORS, name: str = "Country",
) -> tuple[DataFrame, DataFrame]:
    """(similar, aspirational) for a table of entities, from raw columns."""
    df = normalise_columns(df)
    columns = numeric_columns(df, indicators)
    df = drop_sparse(coerce(df, columns), columns)
    scored, t = score(df, target, columns, peer_columns, weights, name)
    shown = [name, *(c for c in peer_columns if c in df.columns)]
    tail = [*columns, *(f"z_{c}" for c in columns), "_missing_n"]
    pick = lambda d, *more: d.select(*(F.col(f"`{c}`") for c in (*shown, "distance", *more, *tail)))
    return pick(nearest(scored, k, name)), pick(aspirational(scored, t, aspirational_k, name=name), "better_count")


def similarity_index(
    df: DataFrame, target: str, indicators: Iterable[str] = INDICATORS, peer_columns: Iterable[str] = (), weights: str | None = None, name: str = "Country"
) -> DataFrame:
    """All entities by ``similarity_distance`` from the target, nearest first; peers only where peer columns are given."""
    df = normalise_columns(df)
    columns = numeric_columns(df, indicators)
    scored, _ = score(drop_sparse(coerce(df, columns), columns), target, columns, peer_columns, weights, name)
    return scored.withColumnRenamed("distance", "similarity_distance").orderBy("similarity_distance", name)


def phase_weighted_score(scores: DataFrame, key: str, phase: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """Extension: per entity the weighted sum of its phases' mean scores."""
    by_phase = scores.groupBy(key, phase).agg(F.avg(value).alias("__mean"))
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return by_phase.groupBy(key).agg(F.sum(F.coalesce(F.try_element_at(w, F.col(phase)), F.lit(0.0)) * F.col("__mean")).alias("weighted_score"))
