"""Near copies by SimHash over word shingles: blocks of fingerprint bits, Hamming distance, then the Jaccard similarity.

The steps are those of ``simhash`` with fingerprints, blocks and a distance made for a similarity: two sets of Jaccard
similarity s have an angle whose cosine is 2 s / (1 + s) or more, and bits of their fingerprints differ with probability
angle / pi. At 0.8 that is 0.15, too much for blocks by the pigeonhole principle (their few bits would hold everyone in
one block), so blocks are of bits drawn from the fingerprint, as many as make a missed pair improbable.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, numbered, settled, without
from .graph import connected_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Fingerprints have so many longs of 64 bits, the first ``SENT`` of which go to the blocks; ``PREFIX`` of these are compared first.
LANES, SENT, PREFIX = 8, 4, 2
BITS = 64 * LANES
#: Were fingerprints random, a block would have about so many.
BLOCK = 1024
#: A pair just as similar as asked for shares no block with at most this probability.
MISSED = 1e-4
#: Standard deviations by which the distance of a similar pair may exceed its mean.
BEYOND = 6
#: Rows that are compared with a whole block at once.
ROWS = 64
#: What is compared whole in one task has so many rows and shingles at most; larger blocks are cut into tiles.
TILE_ROWS, TILE_SHINGLES = 4096, 2_000_000
#: Bits of a set's parity map, as longs.
PARITY = 16
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 64, LANES, dtype=np.uint64) | np.uint64(1)
ADDENDS = _random.integers(0, 1 << 64, LANES, dtype=np.uint64)
#: For each byte its eight bits in the bytes of a long, so that up to 255 are counted in one sum.
_COUNTED = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all shingles of words; words as in ``simhash.fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)), dtype=np.uint64, count=n))


def set_key(hashes: np.ndarray) -> int:
    """A signed long that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, as ``LANES`` unsigned longs: per bit the majority over hashes made of ``hashes``."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # bounded memory for very long texts
        h = hashes[at : at + 255, None] * FACTORS + ADDENDS
        h = (h ^ (h >> np.uint64(32))) * FACTORS[0]
        ones += _COUNTED[(h ^ (h >> np.uint64(29))).view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def apart(similarity: float = SIMILARITY) -> float:
    """With which probability a bit of two sets of that similarity differs."""
    return acos(2 * similarity / (1 + similarity)) / pi


def farthest(similarity: float = SIMILARITY, bits: int = BITS) -> int:
    """The Hamming distance of ``bits`` bits that sets of that similarity don't exceed, but for some 1e-9 of them."""
    p = apart(similarity)
    return ceil(p * bits + BEYOND * sqrt(p * (1 - p) * bits))


def drawn_bits(n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Per block key of ``n`` fingerprints the bits that it is made of; each bit is drawn once before any is drawn again."""
    width, p = min(24, max(2, round(log2(max(n, 1) / BLOCK)))), apart(similarity)
    chance = [comb(BITS, h) * p**h * (1 - p) ** (BITS - h) for h in range(BITS - width + 1)]
    share = np.array([comb(BITS - h, width) / comb(BITS, width) for h in range(BITS - width + 1)])
    keys = 1
    while np.dot(chance, (1 - share) ** keys) > MISSED:
        keys += 1
    random = np.random.default_rng(SEED)
    order = np.concatenate([random.permutation(BITS)[: BITS // width * width] for _ in range(-(-keys * width // (BITS // width * width)))])
    return order[: keys * width].reshape(keys, width)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Per slot whether an odd number of ``hashes`` falls there, as longs.

    The maps of two sets differ in at most as many bits as the sets have shingles that the other lacks.
    """
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch["t"]]
            columns = {"key": [set_key(h) for h in found], "n": [len(h) for h in found], "fp": [fingerprint(h).tobytes() for h in found]}
            yield pd.DataFrame({"row_no": batch["row_no"], "id": batch["id"], **columns})

    return rows.mapInPandas(made, f"row_no long, id {kind}, key long, n long, fp binary")


def _sets(rows: DataFrame) -> DataFrame:
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                found = [shingles(t) for t in batch["t"].iloc[at : at + 500]]
                yield pd.DataFrame({"key": [set_key(h) for h in found], "s": [h.view(np.int64) for h in found], "odd": [parity(h).tobytes() for h in found]})

    return rows.select("t").mapInPandas(made, "key long, s array<long>, odd binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have the similarity; the sets are compared whole."""
    a, b = (sets.select(F.col("key").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return materialise(pairs.join(b, "b").join(a, "a").where(both / (F.size("sa") + F.size("sb") - both) >= similarity).select("a", "b"))


def _in_blocks(rows: DataFrame, bits: np.ndarray, order: str, all_blocks: bool = False) -> DataFrame:
    """``rows`` (fp, ...) once in each of their blocks, with the first bits of fp; blocks are whole in a partition and sorted by ``order``.

    With ``all_blocks``, each row has the list of its blocks too.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = 1 << np.arange(bits.shape[1])
        for batch in batches:
            if len(batch):
                of = np.unpackbits(np.frombuffer(b"".join(batch["fp"]), dtype=np.uint8).reshape(len(batch), -1), axis=1)
                yield batch.assign(fp=[x[: 8 * SENT] for x in batch["fp"]], blocks=[*np.stack([of[:, b] @ values for b in bits], axis=1).astype(np.int32)])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    each = rows.mapInPandas(keyed, ", ".join([*columns, "blocks array<int>"]))
    each = each.select(F.posexplode("blocks").alias("drawn", "block"), *rows.columns, *["blocks"] * all_blocks)
    return each.repartition("drawn", "block").sortWithinPartitions("drawn", "block", order)


def _whole(batches: Iterator[pd.DataFrame], by: tuple[str, ...] = ("drawn", "block")) -> Iterator[pd.DataFrame]:
    """The blocks of a sorted partition, one by one."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = batch[[*by]].to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = batch.iloc[i:j]
            if held and any(held[0][c].iloc[0] != part[c].iloc[0] for c in by):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _maps(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), -1)


def _near(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of ``x`` (across) are near which of ``y`` by the first bits of their fingerprints."""
    differ = sum(np.bitwise_count(x[:, None, i] ^ y[None, :, i]) for i in range(PREFIX))  # at most 128: bytes hold it
    return differ <= farthest(similarity, 64 * PREFIX)


def leaders(fp: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places in a block: each row with the first that leads it and is near, a leader with the nearest row led by another.

    So every row that has another near it is in a pair, and there are at most two pairs a row.
    """
    free, out, most = np.ones(len(fp), dtype=bool), [], farthest(similarity, 64 * fp.shape[1])
    at = 0
    while at < len(fp):
        todo = at + np.flatnonzero(free[at : at + 16 * ROWS])[:ROWS]
        if not len(todo):
            at += 16 * ROWS
            continue
        near = _near(fp[todo], fp, similarity)
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            me = int(todo[i])
            if free[me]:
                others = np.flatnonzero(near[i])
                others = others[(others != me) & (np.minimum(n[others], n[me]) >= similarity * np.maximum(n[others], n[me]) - 1e-6)]
                far = np.bitwise_count(fp[others] ^ fp[me]).sum(axis=1, dtype=np.int64)
                others, far = others[far <= most], far[far <= most]
                new = free[others] & (others > me)
                out += [(me, int(j)) for j in others[new]]
                if (led := ~free[others]).any():
                    out.append((int(others[led][far[led].argmin()]), me))
                free[others[new]] = False
        at = int(todo[-1]) + 1
    return out


def unlinked(block: pd.DataFrame, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near rows of different components in a block (fp, n, root, perhaps odd and blocks) sorted by root.

    By parity maps too, if there are any. Where the rows have their blocks, pairs are left out that meet in an earlier one.
    """
    fp, n, root = _maps(block["fp"]), block["n"].to_numpy(), block["root"].to_numpy()
    odd = _maps(block["odd"]) if "odd" in block else None
    before = np.stack(block["blocks"].to_list())[:, : int(block["drawn"].iloc[0])] if "blocks" in block else None
    after = np.searchsorted(root, root, side="right")  # who may still be of another component
    for at in range(0, len(fp), ROWS):
        start = int(after[at])
        if start == len(fp):
            return
        near = _near(fp[at : at + ROWS], fp[start:], similarity) & (root[at : at + ROWS, None] < root[None, start:])
        i, j = np.nonzero(near)
        i, j = i + at, j + start
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
        i, j = i[fits], j[fits]
        fits = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= farthest(similarity, 64 * fp.shape[1])
        if odd is not None:  # sets of similarity s differ in (1 - s) / (1 + s) of their sizes' sum at most
            least = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            fits &= least <= (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        i, j = i[fits], j[fits]
        if before is not None:
            new = np.ones(len(i), dtype=bool)
            for at_once in range(0, len(i), 16 * BLOCK):
                some = slice(at_once, at_once + 16 * BLOCK)
                new[some] = (before[i[some]] != before[j[some]]).all(axis=1)
            i, j = i[new], j[new]
        yield i, j


def joining(block: pd.DataFrame, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of rows of a block as in ``unlinked``, with their sets ``s``, that have the similarity and join two components.

    Every pair that ``unlinked`` has is in one component by what is returned and by root, or was compared whole and
    lacks the similarity; so there are fewer pairs than rows, however many have the similarity.
    """
    n, of = block["n"].to_numpy(), np.unique(block["root"], return_inverse=True)[1]
    shingle = np.unique(np.concatenate(block["s"].to_list()), return_inverse=True)[1]
    ends = np.cumsum(n)
    sets = [shingle[i:j] for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
    mine, out = np.zeros(len(shingle), dtype=bool), []
    for i, j in unlinked(block, similarity):
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for x, others in zip(i[starts].tolist(), np.split(j, starts[1:]), strict=True) if len(i) else ():
            mine[sets[x]] = True
            for at in range(0, len(others), ROWS):
                y = others[at : at + ROWS]
                if not len(y := y[of[y] != of[x]]):
                    continue
                both = np.add.reduceat(mine[np.concatenate([sets[k] for k in y])], np.cumsum(n[y]) - n[y], dtype=np.int64)
                for k in y[both / (n[x] + n[y] - both) >= similarity].tolist():
                    if of[k] != of[x]:
                        out.append((x, k))
                        of[of == of[k]] = of[x]
            mine[sets[x]] = False
    return out


def _led(rows: DataFrame, bits: np.ndarray, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, n, fp) by ``leaders`` of every block."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole(batches):
            pairs = leaders(_maps(block["fp"]), block["n"].to_numpy(), similarity)
            key = block["key"].to_numpy()[np.array(pairs, dtype=np.int64).reshape(-1, 2)]
            yield pd.DataFrame({"a": key.min(axis=1), "b": key.max(axis=1)})

    return _in_blocks(rows, bits, "key").mapInPandas(found, "a long, b long").distinct()


def _apart_yet(rows: DataFrame, bits: np.ndarray, similarity: float) -> DataFrame:
    """Keys of ``rows`` (key, n, fp, root) that have a near one of another component in a block."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole(batches):
            some = np.zeros(len(block), dtype=bool)
            for i, j in unlinked(block, similarity):
                some[i] = some[j] = True
            yield pd.DataFrame({"key": block["key"].to_numpy()[some]})

    return _in_blocks(rows, bits, "root").mapInPandas(found, "key long").distinct()


def _met(rows: DataFrame, bits: np.ndarray, similarity: float) -> DataFrame:
    """``rows`` (key, n, fp, root, odd) in those of their blocks in which they first meet one of another component that may have the similarity."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole(batches):
            some = np.zeros(len(block), dtype=bool)
            for i, j in unlinked(block, similarity):
                some[i] = some[j] = True
            yield block[some]

    each = _in_blocks(rows, bits, "root", all_blocks=True)
    return each.mapInPandas(found, each.schema)


def _tiled(rows: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """``rows`` of blocks with ``tile``: those of a large block are dealt into parts, and any two parts share a tile."""
    of = F.greatest(F.count(F.lit(1)) / tile_rows, F.sum("n") / tile_shingles)
    parts = materialise(rows.groupBy("drawn", "block").agg(F.ceil(of).cast("int").alias("parts")))
    rows = rows.join(checked_broadcast(parts), ["drawn", "block"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    tile = lambda x: F.least("part", x).cast("long") * F.col("parts") + F.greatest("part", x)
    return rows.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), tile))).drop("part", "parts")


def _joined(met: DataFrame, sets: DataFrame, similarity: float, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Edges (a, b) by ``joining`` of every tile of ``met`` (see ``_met``): fewer than it has rows, whatever a group's size."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole(batches, ("drawn", "block", "tile")):
            key = block["key"].to_numpy()[np.array(joining(block, similarity), dtype=np.int64).reshape(-1, 2)]
            yield pd.DataFrame({"a": key.min(axis=1), "b": key.max(axis=1)})

    rows = _tiled(met, tile_rows, tile_shingles).join(sets.select("key", "s"), "key").repartition("drawn", "block", "tile")
    return rows.sortWithinPartitions("drawn", "block", "tile", "root").mapInPandas(found, "a long, b long").distinct()


def _edges(members: DataFrame, near: DataFrame, sets: DataFrame, bits: np.ndarray, similarity: float) -> DataFrame:
    """Edges over all pairs in one block that have the similarity, without those inside what is linked already.

    The pairs ``near`` of leaders link a group of any size in linear time; what still has a near row of another
    component is then compared pair by pair, with the whole sets, in the block where a pair first meets. Only edges
    that join components leave a block.
    """
    edges = _similar(near, sets, similarity)
    linked = connected_components(edges).withColumnRenamed("node", "key")
    some = checked_broadcast(sets.select("key"), 1_000_000)
    rooted = materialise(members.join(some, "key", "left_semi").join(linked, "key", "left").withColumn("root", F.coalesce("root", "key")))
    rest = checked_broadcast(materialise(_apart_yet(rooted, bits, similarity)), 1_000_000)
    rest = materialise(rooted.join(rest, "key", "left_semi").join(sets.select("key", "odd"), "key"))
    return edges.unionByName(materialise(_joined(materialise(_met(rest, bits, similarity)), sets, similarity)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The ``row_no`` of each row of ``docs`` that another of its component stands for.

    Components are those of five-word shingle sets under the similarity; equal sets are combined first. Defined
    results: texts without words have the empty set and are equal; the smallest id stays, null ids last; of
    repeated rows the first in the files stays; an empty table gives no rows.
    """
    texts = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialise(_signed(texts))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row_no")
    distinct = materialise(rows.groupBy("key", "n").agg(F.min(order).alias("least"), F.first("fp").alias("fp")))
    members = distinct.where("n > 0").select("key", "n", "fp")
    bits = drawn_bits(members.count(), similarity)
    near = materialise(_led(members, bits, similarity))
    wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = distinct.join(wanted, "key", "left_semi").select(F.col("least")["row_no"].alias("row_no"))
    sets = materialise(_sets(texts.join(checked_broadcast(materialise(wanted), 1_000_000), "row_no", "left_semi")))
    linked = settled(lambda: connected_components(_edges(members, near, sets, bits, similarity))).withColumnRenamed("node", "key")
    rooted = distinct.join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    stays = rooted.join(least, "root").select("key", F.col("first")["row_no"].alias("stays"))
    return rows.join(stays, "key").where("row_no <> stays").select("row_no")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of ``near_copies``; all columns stay, whatever their names."""
    return without(docs, lambda d: near_copies(d, id_col, text_col, similarity))
