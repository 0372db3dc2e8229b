"""Exact top-k of many queries: vectors dealt around pivots, distances that rule out whole chunks, blocks of products.

Cosine is a distance on unit vectors, so the triangle inequality holds: what lies around a pivot at distances from lo to
hi is at least max(d - hi, lo - d) from a query at distance d of the pivot. Vectors are sorted by pivot and distance and
compared in chunks; a chunk too far for a query's k best so far is skipped, the others are compared by one matrix
product. That product only proposes: rounded scores within a margin of the k-th go on, and the expression that defines
the score ranks them, so the result is that of a full scan, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles, norm

#: Vectors that others are dealt around; rows that are compared at once; how far products may be off.
PIVOTS, ROWS, MARGIN = 128, 1024, 1e-9


@dataclass
class Report:
    """Pairs of a query and a vector: all, and those whose product was computed. Counts of a run that was ended go on."""

    def __init__(self, spark: SparkSession) -> None:
        self.pairs, self.compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @property
    def skipped(self) -> float:
        return 1 - self.compared.value / self.pairs.value if self.pairs.value else 0.0


def _units(vectors: pa.ListArray, norms: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, cut or filled up with zeros to ``width``; and which are odd: without a length, or not finite."""
    n = np.asarray(norms.fill_null(np.nan), np.float64)
    offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values.fill_null(0.0), np.float64)
    sizes = np.diff(offsets)
    odd = ~(np.isfinite(n) & (n > 0))
    if len(sizes) and (sizes == width).all():
        out = flat[offsets[0] : offsets[-1]].reshape(-1, width).copy()
    else:
        out = np.zeros((len(sizes), width))
        for i, (start, size) in enumerate(zip(offsets[:-1].tolist(), np.minimum(sizes, width).tolist(), strict=True)):
            out[i, :size] = flat[start : start + size]
    out[odd] = 0
    out /= np.where(odd, 1, n)[:, None]
    return out, odd


def _distances(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * products, 0))


def around_pivots(rows: DataFrame, pos: str, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with vector __v and length __n, dealt out and sorted by nearest pivot __p and distance __d; the pivots.

    Pivots are the rows with the smallest hashes of ``pos``. Rows without a finite length belong to none: -1. Ranges of
    distances split a pivot that very many rows are near.
    """
    spark = rows.sparkSession
    usable = (F.col("__n") > 0) & (F.col("__n") < float("inf"))
    chosen = rows.where(usable).orderBy(F.xxhash64(pos), pos).select("__v", "__n").limit(pivots).collect()
    width = max((len(r["__v"]) for r in chosen), default=0)
    units = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        units[i, : len(r["__v"])] = np.array([x or 0.0 for x in r["__v"]]) / r["__n"]
    shared = spark.sparkContext.broadcast(units)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, odd = _units(b.column("__v"), b.column("__n"), shared.value.shape[1])
            near, d = np.full(len(u), -1, np.int32), np.zeros(len(u))
            if len(shared.value):
                products = u @ shared.value.T
                best = products.argmax(1)
                near, d = np.where(odd, -1, best).astype(np.int32), np.where(odd, 0, _distances(products[np.arange(len(u)), best]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d)], [*b.schema.names, "__p", "__d"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__p int", "__d double"])
    dealt = rows.mapInArrow(assigned, schema).repartitionByRange("__p", "__d", pos).sortWithinPartitions("__p", "__d", pos)
    return dealt, units


class _Search:
    """The k best scores so far of each query of a task, and what can still be among them."""

    def __init__(self, queries: np.ndarray, odd: np.ndarray, pivots: np.ndarray, k: int) -> None:
        self.q, self.odd, self.k = queries, odd, k
        width = min(pivots.shape[1], queries.shape[1]) if len(pivots) else 0
        near = queries[:, :width] @ pivots[:, :width].T
        self.away = _distances(near)
        self.best = np.full((len(queries), k), -np.inf)
        # the pivots are rows too: their k-th score is a bound from the start
        self.least = np.where(odd, -np.inf, np.sort(near, 1)[:, -k] if near.shape[1] >= k else -np.inf)

    def chunk(self, units: np.ndarray, odd: np.ndarray, copies: np.ndarray, pivot: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, query) of what may be among the k best, and how many queries were compared. ``copies``: how many equal rows come before."""
        reach = np.ones(len(self.q), bool)
        if pivot >= 0:
            bound = np.maximum(np.maximum(self.away[:, pivot] - d.max(), d.min() - self.away[:, pivot]), 0)
            reach = 1 - bound * bound / 2 >= self.least - MARGIN
        reach &= ~self.odd
        which = np.flatnonzero(reach)
        if not len(which):
            return np.empty(0, int), np.empty(0, int), 0
        scores = units @ self.q[which].T
        scores[odd] = -np.inf
        top = scores if len(scores) <= self.k else np.partition(scores, -self.k, 0)[-self.k :]
        both = np.concatenate([self.best[which], top.T], 1)
        self.best[which] = np.partition(both, -self.k, 1)[:, -self.k :]
        self.least[which] = np.maximum(self.least[which], self.best[which].min(1))
        row, query = np.nonzero(((scores >= self.least[which] - MARGIN) & (copies < self.k)[:, None]) | odd[:, None])
        return row, which[query], len(which)


def nearest(index: DataFrame, queries: DataFrame, k: int, query_id: str, pos: str, report: Report | None = None) -> DataFrame:
    """The k most similar rows of ``index`` for each of ``queries`` (query_id, query), which are few enough to be sent to all tasks."""
    spark = index.sparkSession
    rows = index.where(F.size("embedding") > 0).withColumn("__v", doubles(F.col("embedding")))
    rows = rows.withColumn("__n", F.col("norm") if "norm" in index.columns else norm(F.col("__v"))).drop("embedding", "norm")
    q = queries.select(query_id, doubles(F.col("query")).alias("__q")).withColumn("__qn", norm(F.col("__q")))
    asked = q.toArrow().combine_chunks().to_batches()
    rows, pivots = around_pivots(rows, pos)
    width = max((len(v) for b in asked for v in b.column("__q").to_pylist() if v), default=0)
    if not asked or not width:
        asked, width = [], 0
    found = [_units(b.column("__q"), b.column("__qn"), width) for b in asked]
    units, odd = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros((0, 0)), np.zeros(0, bool))
    ids = pa.concat_arrays([b.column(query_id) for b in asked]) if asked else None
    shared = spark.sparkContext.broadcast((units, odd, pivots, ids))
    names = [c for c in rows.columns if c not in ("__p", "__d")]

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, odd_query, pivots, ids = shared.value
        if ids is None:
            return
        search = _Search(units, odd_query, pivots, k)
        nowhere = np.flatnonzero(odd_query)
        for b in batches:
            u, odd = _units(b.column("__v"), b.column("__n"), units.shape[1])
            p, d = np.asarray(b.column("__p")), np.asarray(b.column("__d"))
            cut = np.unique(np.concatenate([np.flatnonzero(np.diff(p)) + 1, np.arange(0, len(p), ROWS), [len(p)]]))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                seen: dict[bytes, int] = {}
                copies = np.zeros(y - x, int)
                for i, v in enumerate(u[x:y]):
                    copies[i] = seen.get(v.tobytes(), 0)
                    seen[v.tobytes()] = copies[i] + 1
                row, query, n = search.chunk(u[x:y], odd[x:y], copies, int(p[x]), d[x:y])
                if report:
                    report.pairs.add((y - x) * len(units))
                    report.compared.add((y - x) * n)
                if len(nowhere):  # all scores of a query without a length are 0, so the first rows are its best; odd rows may differ
                    first = np.asarray(pc.sort_indices(b.column(pos).slice(x, y - x)))[:k].astype(np.int64)
                    first = np.union1d(first, np.flatnonzero(odd[x:y]))
                    row, query = np.append(row, np.tile(first, len(nowhere))), np.append(query, np.repeat(nowhere, len(first)))
                for at in range(0, len(row), 10_000):
                    some = b.select(names).take(pa.array(x + row[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([*some.columns, ids.take(pa.array(query[at : at + 10_000]))], [*names, "__query"])

    kind = queries.schema[query_id].dataType.simpleString()
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), f"__query {kind}"])
    close = rows.mapInArrow(proposed, schema).withColumnRenamed("__query", query_id)
    scored = close.join(F.broadcast(q), query_id).withColumn("score", cosine(F.col("__v"), F.col("__q"), F.col("__n"), F.col("__qn")))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), pos)
    return scored.drop("__v", "__n", "__q", "__qn").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
