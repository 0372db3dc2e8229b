"""Mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first."""

from __future__ import annotations

import heapq
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, materialise, numbered, rank_within, settled, stable

#: Documents of a source that are scheduled together, and the parts that target weights are given in.
BLOCK, PARTS = 16, 1000
#: The schedule has a table per source; more sources than this are an error (pool small ones beforehand).
MOST_SOURCES = 2_000


def tempered_weights(counts: dict[str, int], exponent: float = 0.5, parts: int = PARTS) -> dict[str, int]:
    """Whole parts in proportion to ``counts`` to a power below one: small sources count more than their size."""
    total = sum(n**exponent for n in counts.values()) or 1
    return {s: max(1, round(parts * n**exponent / total)) for s, n in counts.items()}


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's jobs in one period of sum(weights) slots.

    Job j of a source with weight w of W is released at floor(j W / w) and due at ceil((j + 1) W / w); of
    those released the one that is due first gets the slot. The weights fill every slot, so all deadlines are
    met and at any slot each source is less than one block from its target.
    """
    whole = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(whole):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * whole // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if (j := len(slots[s])) < weights[s]:
            heapq.heappush(waiting, (j * whole // weights[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """Per source its phases (first block, first slot, slots of a period, slots of its jobs in a period).

    A phase ends when a source has no block left; the others go on with their weights in proportion.
    """
    out: dict[str, list] = {s: [] for s in blocks}
    done, base = dict.fromkeys(blocks, 0), 0
    active = {s for s, n in blocks.items() if n}
    while active:
        g = reduce(gcd, (weights[s] for s in active))
        w = {s: weights[s] // g for s in active}
        whole, slots = sum(w.values()), period(w)
        at = lambda s, j: j // w[s] * whole + slots[s][j % w[s]]  # noqa: B023, E731
        end = min(at(s, blocks[s] - done[s] - 1) + 1 for s in active)
        for s in active:
            out[s].append((done[s], base, whole, slots[s]))
            rest = end % whole
            done[s] += end // whole * w[s] + sum(x < rest for x in slots[s])
        base += end
        active = {s for s in active if done[s] < blocks[s]}
    return out


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: row_no, id, source, ``block``, ``slot`` and ``position``, its place in the mixed order.

    ``weights``: whole parts by source (sources without: one part); by default ``tempered_weights``. A
    source's documents are ranked in a random but repeatable order and cut into blocks. The driver makes the
    schedule of a period, whose size depends on the sources and parts alone; every document finds its slot
    by arithmetic. As long as all sources last, the first n slots hold each source's share to less than one
    block; when one is used up, the others share its part. No document is dropped or repeated: the mixture is
    in the order. ``position`` increases with (slot, rank in the block); the last block of a source may be short.

    Defined results: null source is the source ''; null ids stay null; repeated rows are rows of their own; an
    empty table gives no rows; other columns are ignored.
    """
    rows = materialise(numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: pool the small ones")
    given = tempered_weights(counts) if weights is None else {s: max(1, int(weights.get(s, 1))) for s in counts}
    plan = phases({s: -(-n // block) for s, n in counts.items()}, given)
    table = [(s, [p[0] for p in ps], [p[1] for p in ps], [p[2] for p in ps], [p[3] for p in ps]) for s, ps in plan.items()]
    schedule = docs.sparkSession.createDataFrame(table, "source string, first array<long>, base array<long>, whole array<long>, slots array<array<int>>")
    ranked = rank_within(rows, ["source"], ["row_no"], sum(counts.values()), "rank")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    found = ranked.join(F.broadcast(schedule), "source")  # at most MOST_SOURCES rows
    b = F.col("block")
    found = found.withColumn("phase", F.size(F.filter("first", lambda x: x <= b)) - 1)
    found = found.withColumn("jobs", F.get("slots", F.col("phase"))).withColumn("job", b - F.get("first", F.col("phase")))
    n = F.size("jobs")
    slot = F.get("base", F.col("phase")) + F.floor(F.col("job") / n).cast("long") * F.get("whole", F.col("phase")) + F.get("jobs", (F.col("job") % n).cast("int"))
    return found.withColumn("slot", slot.cast("long")).select(
        "row_no", F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot",
        (F.col("slot") * block + F.col("rank") % block).alias("position"),
    )


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in the mixed order (range-partitioned and sorted by ``position``); all columns stay, whatever their names."""
    docs = stable(docs)
    mine, at = fresh(docs, "__row_no"), fresh(docs, "__position")
    place = settled(lambda: mix(docs, weights, block, id_col, source_col).select(F.col("row_no").alias(mine), F.col("position").alias(at)))
    rows = numbered(docs, name=mine).join(checked_broadcast(place, 1_000_000), mine)
    return rows.orderBy(at).select(*(F.col(f"`{c}`") for c in docs.columns))
