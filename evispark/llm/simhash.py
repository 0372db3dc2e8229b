"""SimHash near-dedup: pigeonhole blocks of fingerprints, joined, then verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, numbered, settled, without
from .graph import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints that share a block are compared in one task up to this many; beyond it by ``_by_balls``.
LARGE = 4_000
#: Blocks are added until, were fingerprints random, a block's value would have at most this many.
CROWD = 4


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: the majority over the hashes of all shingles of words; zero without words.

    A-Z count as a-z, a word is a run without ASCII white space; fewer words than a shingle form one.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: row_no, id and ``fp``, the fingerprint as a signed long. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"row_no": batch["row_no"], "id": batch["id"], "fp": fp})

    rows = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(made, f"row_no long, id {kind}, fp long")


def masks(n_blocks: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks, each of ``n_blocks - distance`` blocks: of two fingerprints within the distance one mask's bits agree."""
    cuts = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - distance)]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks; more for more fingerprints, so that blocks stay sparse. The links found are the same."""
    b = distance + 1
    while n >> (64 * (b - distance) // b) > CROWD and b < distance + 6:
        b += 1
    return b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected among ``fp``: stars from whatever is reached, not all pairs."""
    out, left = [], fp
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        root = int(reached[0])
        while len(reached) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for x in reached:
                near |= np.bitwise_count(left ^ x) <= distance
                if near.all():
                    break
            reached, left = left[near], left[~near]
            out += [(root, int(x)) for x in reached]
    return out


def _in_blocks(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Edges within each run of one (mask, block) of a partition sorted by them."""
    held = None
    for batch in _ended(batches):
        if batch is not None:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if held is None or not len(held):
            continue
        m, k, fp = held["mask"].to_numpy(), held["block"].to_numpy(), held["fp"].to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])])
        ends = np.r_[starts[1:], len(held)]
        if batch is not None:  # the last run may go on
            held = held.iloc[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        size, edges = ends - starts, []
        two = starts[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance] if len(two) else two
        edges = [*zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True)] if len(two) else []
        for i in np.flatnonzero(size > 2):
            edges += _links(fp[starts[i] : ends[i]], distance)
        pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _by_balls(crowded: DataFrame, distance: int) -> DataFrame:
    """Edges within blocks that have very many fingerprints, at a cost linear in them.

    Two fingerprints within ``distance`` reach a common word by flipping half as many bits each; whoever
    shares such a word is within the distance. So each is linked to the smallest that reaches the same word.
    """
    half = -(-distance // 2)
    flips = np.array([sum(1 << b for b in c) for r in range(half + 1) for c in combinations(range(64), r)], dtype=np.uint64)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, fp in zip(batch["mask"].to_numpy().view(np.uint64), batch["fp"].to_numpy().view(np.uint64), strict=True):
                z = flips[(flips & mask) == 0] ^ fp
                yield pd.DataFrame({"z": z.view(np.int64), "fp": np.full(len(z), fp).view(np.int64)})

    reach = crowded.mapInPandas(words, "z long, fp long").distinct()
    least = reach.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return reach.join(least, "z").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def link_edges(distinct: DataFrame, n: int, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Edges (a, b) over the column ``fp`` of ``distinct`` (no repeats) that give its components under the distance."""
    if distance % 2:
        large = 1 << 62  # balls need an even distance
    keys = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for m in masks(blocks_for(n, distance), distance)))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.block", "fp")
    crowd = rows.groupBy("mask", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).drop("n")
    crowd = materialise(crowd)
    fine = rows
    if some := bool(crowd.take(1)):
        crowd = checked_broadcast(crowd)
        fine = rows.join(crowd, ["mask", "block"], "left_anti")
    edges = fine.repartition("mask", "block").sortWithinPartitions("mask", "block", "fp").mapInPandas(lambda b: _in_blocks(b, distance), "a long, b long")
    return edges.unionByName(_by_balls(rows.join(crowd, ["mask", "block"]), distance)) if some else edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Per row of ``docs``: row_no, id, ``fingerprint`` (hex), ``component_id``, ``first`` (whether it is the one to stay).

    Equal fingerprints are combined first, so copies cost a row each and no comparison. Different ones meet
    in blocks; every link within the distance is honoured, whatever a block's size (see ``_by_balls``).

    Defined results: texts without words have fingerprint zero and are linked like any other; component_id
    is the smallest id that is not null; null ids come last when the one to stay is chosen; of repeated
    rows the first in the files stays; an empty table gives no rows; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row_no")
    distinct = materialise(fps.groupBy("fp").agg(F.min(order).alias("least")))
    n = distinct.count()
    linked = settled(lambda: connected_components(link_edges(distinct.select("fp"), n, distance, large)))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of = rooted.join(least, "root").select("fp", "first")
    return fps.join(of, "fp").select(
        "row_no",
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first")["id"].alias("component_id"),
        (F.col("first")["row_no"] == F.col("row_no")).alias("first"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component; all columns stay, whatever their names.

    Nulls, ties and repeated rows as in ``simhash_components``; an empty table stays empty.
    """
    return without(docs, lambda d: simhash_components(d, id_col, text_col, distance).where("NOT first"))
