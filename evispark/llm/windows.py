"""Windows of a fixed length that occur more than once in a corpus: what both substring operators share.

A window is ``length`` consecutive units (bytes or words) of one document. Its *anchor* is the place of its
least hashed gram; equal windows have equal anchors at equal offsets. So it is enough to compare documents
around anchors whose gram occurs again:

1. every document's anchors are listed, as numbers; grams that occur once are settled by counting. Where a document
   repeats itself with a period, as a run of one byte does, only the windows of the first period are listed: the
   others are copies of them, noted as one stretch;
2. documents with other anchors give, per anchor, its *context*: the units of all windows that have it;
3. equal contexts are combined. What only some windows of different contexts share is found by a *matcher*
   (suffix sort or FM-index), per shard of whole anchor groups;
4. groups of too many different contexts for one task are dealt anew by narrower ranges of offsets and the
   units that all windows of a range share, at last one window at a time, where equal ones combine. So no
   group is collected whole, dropped or cut, however many documents share a passage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked_broadcast, join_hot, materialise, settled, small_enough

#: Units that are treated at once; longer documents are walked in steps that overlap by a window.
SEGMENT = 1 << 22
#: Different contexts of one anchor that go to a matcher together. Beyond it, ranges of offsets this wide.
LARGE = 256
#: Bytes of contexts that are given on at once.
MADE = 8 << 20


def widths(length: int) -> tuple[int, int]:
    return max(1, length // 9), 1


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i, modulo 2 ** 64, for at least ``n`` values of i."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes."""
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(_BASE, len(units)), out=out[1:])
    return out


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each run of ``k`` units, the same wherever it stands."""
    p = prefix_hashes(units)
    g = (p[k:] - p[:-k]) * powers(_INVERSE, len(units) - k + 1)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def anchors(units: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, anchor, first window, last window) for each run of windows that share an anchor, segment by segment."""
    for at in range(0, max(1, len(units) - length + 1), SEGMENT):
        part = units[at : at + SEGMENT + length - 1]
        if len(part) < length:
            break
        g = gram_hashes(part, k)
        place = np.uint64((1 << 24) - 1)
        least = sliding_min((g & ~place) | np.arange(len(g), dtype=np.uint64), length - k + 1) & place
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], len(least)] - 1
        a = least[first].astype(np.int64)
        yield g[a].view(np.int64), a + at, first + at, last + at


def copied(hashes: np.ndarray, same: Callable[[int, int, int], bool], anchored: tuple, length: int) -> list[tuple[int, int, int]]:
    """(first, last, period): stretches of windows each of which equals the one a period before, in order and apart.

    Looked for where anchors of one gram follow at one distance, among their windows. ``same(x, y, n)`` compares n
    units from x with those from y, for what equal hashes propose. What a stretch repeats is never in a stretch itself.
    """
    key, a, first, last = anchored
    step = np.where(key[1:] == key[:-1], a[1:] - a[:-1], 0)
    cut = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])[: len(step) + 1]
    out, free = [], 0  # the first anchor that no stretch has used
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        p, x = int(step[x]), max(x, free)
        lo, hi = int(first[x]), int(last[y])
        if p <= 0 or x >= y or hi - lo < p:
            continue
        free = y + 1
        wrong = np.flatnonzero(hashes[lo : hi + length - p] != hashes[lo + p : hi + length])
        start = np.r_[0, wrong + 1]
        end = np.r_[wrong, hi + length - p - lo] - length
        for s, e in zip(start[end >= start].tolist(), end[end >= start].tolist(), strict=True):
            if same(lo + s, lo + s + p, e - s + length):
                out.append((lo + s + p, lo + e + p, p))
    return out


def uncopied(anchored: tuple, copies: list[tuple[int, int, int]]) -> tuple:
    """The anchors with their windows less those in the stretches."""
    if not copies:
        return anchored
    key, a, first, last = anchored
    starts, ends = (np.array([c[i] for c in copies]) for i in (0, 1))
    near = np.searchsorted(ends, first)
    touched = (near < len(ends)) & (starts[np.minimum(near, len(ends) - 1)] <= last)
    inside = touched & (starts[np.minimum(near, len(ends) - 1)] <= first) & (ends[np.minimum(near, len(ends) - 1)] >= last)
    pieces = [(i, first[i], last[i]) for i in np.flatnonzero(~touched).tolist()]
    for i in np.flatnonzero(touched & ~inside).tolist():
        s, j = int(first[i]), int(near[i])
        while j < len(ends) and starts[j] <= last[i]:
            if s < starts[j]:
                pieces.append((i, s, int(starts[j]) - 1))
            s, j = int(ends[j]) + 1, j + 1
        if s <= last[i]:
            pieces.append((i, s, int(last[i])))
    pieces.sort()
    i, s, e = (np.array([x[k] for x in pieces], dtype=np.int64) for k in range(3))
    return key[i], a[i], s, e


def with_copies(first, last, copies, every: bool) -> tuple[list[int], list[int]]:
    """Runs of windows with those of copies: all windows of a stretch and of what it repeats, or those that repeat a run's.

    ``first``, ``last``: runs of windows that occur again, or null. ``every``: whatever is repeated in the text itself counts.
    """
    runs = sorted(zip(first, last, strict=True)) if first is not None else []
    if copies is None or not len(copies):
        return [x for x, _ in runs], [y for _, y in runs]
    if every:
        more = [(c["first"] - c["period"], c["last"]) for c in copies]
    else:
        more, ends = [], []
        for x, y in runs:  # apart, so that ends are in order
            if ends and x <= ends[-1][1] + 1:
                ends[-1][1] = max(ends[-1][1], y)
            else:
                ends.append([x, y])
        reach = [y for _, y in ends]
        for c in copies:
            at, stop, p = c["first"] - c["period"], c["last"], c["period"]
            k = bisect_left(reach, at)
            while k < len(ends) and ends[k][0] < at + p:
                x, y = max(ends[k][0], at), min(ends[k][1], at + p - 1)
                if y - x + 1 == p:
                    more.append((at, stop))
                else:
                    more += [(s, min(s + y - x, stop)) for s in range(x + p, stop + 1, p)]
                k += 1
    return [x for x, _ in (*runs, *more)], [y for _, y in (*runs, *more)]


class Bytes:
    """Units are the bytes of a text in UTF-8."""

    _table = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], dtype=np.uint64)

    def split(self, text: bytes) -> bytes:
        return text

    def hashes(self, units: bytes) -> np.ndarray:
        return self._table[np.frombuffer(units, dtype=np.uint8)]

    def join(self, units: bytes) -> bytes:
        return units

    def same(self, units: bytes, x: int, y: int, n: int) -> bool:
        return True  # each byte has a hash of its own


class Words:
    """Units are words: runs without ASCII white space."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def hashes(self, units: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 300_000:
            known.clear()
        for w in units:
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, units), dtype=np.uint64, count=len(units))

    def join(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def same(self, units: list[bytes], x: int, y: int, n: int) -> bool:
        return all(units[x + i] == units[y + i] for i in range(n))


def sliced(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """Batches in slices, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


#: (group of each context, contexts, their anchors' places, their orders) -> (context, first window, last window)
Matcher = Callable[[np.ndarray, list[bytes], np.ndarray, np.ndarray], Iterator[tuple[int, int, int]]]


def _sharded(batches: Iterator[pd.DataFrame], matcher: Matcher, chunk: int) -> Iterator[pd.DataFrame]:
    """Runs the matcher over whole groups of a partition sorted by group, about ``chunk`` bytes at once."""

    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy()
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        found = list(matcher(group, rows["ctx"].tolist(), rows["a"].to_numpy(), rows["ord"].to_numpy()))
        i = [x[0] for x in found]
        return pd.DataFrame({"cid": rows["cid"].to_numpy()[i], "first": [x[1] for x in found], "last": [x[2] for x in found]})

    held: list[pd.DataFrame] = []
    size = 0
    for batch in (b.iloc[i : i + 1000] for b in batches for i in range(0, len(b), 1000)):
        held.append(batch)
        size += int(batch["ctx"].str.len().sum())
        if size < chunk:
            continue
        rows = pd.concat(held, ignore_index=True)
        cut = int(np.flatnonzero(rows["key"].to_numpy() != rows["key"].iloc[-1]).max(initial=-1)) + 1
        if cut:
            yield matched(rows.iloc[:cut])
        held = [rows.iloc[cut:]]
        size = int(held[0]["ctx"].str.len().sum())
    if held and len(rows := pd.concat(held, ignore_index=True)):
        yield matched(rows)


def _runs(items: DataFrame, units, matcher: Matcher, length: int, earlier: bool, chunk: int, large: int, level: int = 0) -> DataFrame:
    """(pid, first, last): the windows of ``items`` that occur again, counted from each item's start.

    items: pid, ord, key, ctx, a, n_windows. With ``earlier`` only occurrences in items of a smaller ord
    count, else any other occurrence.
    """
    items = materialise(items.withColumn("cid", F.md5(F.concat(F.hex("key").cast("binary"), F.col("ctx")))))
    combined = items.groupBy("key", "ctx", "a", "n_windows").agg(F.min(F.struct("ord", "pid")).alias("lead"), F.count(F.lit(1)).alias("n"))
    combined = combined.select("key", "ctx", "a", "n_windows", F.col("lead")["ord"].alias("ord"), F.col("lead")["pid"].alias("pid"), "n")
    distinct = materialise(combined.withColumn("cid", F.md5(F.concat(F.hex("key").cast("binary"), F.col("ctx")))))
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    sizes = materialise(sizes)
    # items whose context others have too; a context may have any share of the items
    several = distinct.where("n > 1").select("cid", "n", F.col("ord").alias("least"), F.col("pid").alias("lead"))
    told = join_hot(items.select("pid", "cid", "ord", "n_windows"), several, "cid", "n", items.count())
    whole = told.where("least < ord") if earlier else told
    whole = whole.select("pid", F.lit(0).cast("long").alias("first"), (F.col("n_windows") - 1).cast("long").alias("last"))
    shards = distinct.join(sizes.where(F.col("g") <= large), "key").select("key", "ctx", "a", "ord", "cid")
    schema = "cid string, first long, last long"
    part = shards.repartition("key").sortWithinPartitions("key", "cid").mapInPandas(lambda b: _sharded(b, matcher, chunk), schema)
    crowd = sizes.where(F.col("g") > large).select("key")
    if level < 2 and crowd.take(1):  # at width 1 a group is one context
        width = widths(length)[level]
        crowded = distinct.join(checked_broadcast(crowd), "key").select("key", "ctx", "a", "ord", "cid", "n_windows")

        def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key, ctx, a, ord_, cid, n in zip(*(batch[c] for c in ("key", "ctx", "a", "ord", "cid", "n_windows")), strict=True):
                    u = units.split(ctx)
                    for c in range((a - n + 1) // width, a // width + 1):  # offsets a - s of the windows s
                        hi, lo = min(a, c * width + width - 1), max(a - n + 1, c * width)
                        s, e = a - hi, a - lo  # first and last window of the part
                        core = units.join(u[a - c * width : a - c * width - width + 1 + length])  # in every window of the range
                        new = xxhash.xxh3_64_intdigest(b"%d %d " % (key, c) + core) - (1 << 63)
                        out.append((f"{cid} {s}", ord_, new, units.join(u[s : e + length]), a - s, e - s + 1))
                yield pd.DataFrame(out, columns=["pid", "ord", "key", "ctx", "a", "n_windows"])

        sub = crowded.mapInPandas(narrowed, "pid string, ord long, key long, ctx binary, a int, n_windows int")
        found = _runs(sub, units, matcher, length, earlier, chunk, large, level + 1)
        at = F.split("pid", " ")[1].cast("long")
        found = found.select(F.split("pid", " ")[0].alias("cid"), (F.col("first") + at).alias("first"), (F.col("last") + at).alias("last"))
        part = part.unionByName(found)
    # only items that aren't whole need the parts: one item of each context, and with ``earlier`` those of its order
    rest = distinct.where("true" if earlier else "n = 1").select("pid", "cid")
    if earlier:
        rest = rest.unionByName(told.where("least >= ord AND pid <> lead").select("pid", "cid"))
    return whole.unionByName(rest.join(part, "cid").select("pid", "first", "last"))


def repeated_windows(
    docs: DataFrame, units_type, matcher: Matcher, length: int, gram: int, earlier: bool, chunk: int, large: int = LARGE
) -> DataFrame:
    """(row_no, first, last, n_shared, copies): arrays of the runs of windows that occur again, the number of the
    row's anchors whose gram another order has too, and the stretches of copies (see ``with_copies``); per row with any.

    docs: row_no, ord (long; with ``earlier`` only occurrences in rows of a smaller ord count), t (text).
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_type()
        for batch in sliced(batches):
            found, n, rows, orders, periods = [], [], [], [], []
            for row, ord_, t in zip(batch["row_no"], batch["ord"], batch["t"], strict=True):
                u = units.split(t.encode("utf-8", "surrogatepass"))
                hashes = units.hashes(u) if len(u) >= length else None
                for some in anchors(hashes, length, gram) if hashes is not None else ():
                    copies = copied(hashes, lambda x, y, m, u=u: units.same(u, x, y, m), some, length)
                    some = uncopied(some, copies)
                    c0, c1, p = np.array(copies, dtype=np.int64).reshape(-1, 3).T
                    found.append([np.r_[x, y] for x, y in zip(some, (0 * p, 0 * p, c0, c1), strict=True)])
                    periods.append(np.r_[0 * some[0], p])
                    n.append(len(found[-1][0]))
                    rows.append(row)
                    orders.append(ord_)
            if found:
                key, a, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"row_no": np.repeat(rows, n), "ord": np.repeat(orders, n), "key": key, "a": a, "first": first, "last": last, "period": np.concatenate(periods)})

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_type()
        columns = ["pid", "ord", "key", "ctx", "a", "n_windows"]
        for batch in sliced(batches):
            out, size = [], 0
            for row, ord_, t, *found in zip(*(batch[c] for c in ("row_no", "ord", "t", "key", "a", "first", "last")), strict=True):
                u = units.split(t.encode("utf-8", "surrogatepass"))
                for key, a, first, last in zip(*(x.tolist() for x in found), strict=True):
                    out.append((f"{row} {first}", ord_, key, units.join(u[first : last + length]), a - first, last - first + 1))
                    size += len(out[-1][3])
                    if size > MADE:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    rows = docs.select("row_no", "ord", "t")

    def anchored() -> DataFrame:
        every = materialise(rows.mapInPandas(listed, "row_no long, ord long, key long, a int, first int, last int, period int"))
        listing = every.where("period = 0").drop("period")
        again = listing.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
        again = materialise(again.where("lo < hi" if earlier else "n > 1").select("key", "n", (F.col("lo") < F.col("hi")).alias("others")))
        met = join_hot(listing, again, "key", "n", listing.count())
        met = met.groupBy("row_no").agg(F.collect_list(F.struct("key", "a", "first", "last")).alias("found"), F.sum(F.col("others").cast("int")).cast("long").alias("n_shared"))
        copies = every.where("period > 0").groupBy("row_no").agg(F.collect_list(F.struct("first", "last", "period")).alias("copies"))
        return met.join(copies, "row_no", "full")

    found = settled(anchored)
    met = found.where("found IS NOT NULL")
    some = rows.join(checked_broadcast(met.select("row_no"), 1_000_000), "row_no", "left_semi")
    places = met.select("row_no", *(F.col(f"found.{c}").alias(c) for c in ("key", "a", "first", "last")))
    items = some.join(places, "row_no").mapInPandas(contexts, "pid string, ord long, key long, ctx binary, a int, n_windows int")
    runs = _runs(items, units_type(), matcher, length, earlier, chunk, large)
    at = F.split("pid", " ")[1].cast("long")
    runs = runs.select(F.split("pid", " ")[0].cast("long").alias("row_no"), F.struct((F.col("first") + at).alias("first"), (F.col("last") + at).alias("last")).alias("run"))
    runs = runs.groupBy("row_no").agg(F.collect_set("run").alias("runs"))
    return found.select("row_no", "n_shared", "copies").join(runs, "row_no", "left").select("row_no", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"), "n_shared", "copies")


def with_runs(rows: DataFrame, runs: Callable[[], DataFrame]) -> DataFrame:
    """Rows (row_no, …) with their runs; the texts of rows without any aren't shuffled while those with some are few."""
    found = settled(runs)
    if not small_enough(found, 5 * BROADCAST_ROWS):
        return rows.join(found, "row_no", "left")
    some = F.broadcast(found.select("row_no"))  # at most 5 * BROADCAST_ROWS numbers
    none = rows.join(some, "row_no", "left_anti").withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in found.columns if c != "row_no"})
    return none.unionByName(rows.join(some, "row_no", "left_semi").join(found, "row_no"))


def covered(first, last, length: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of units that runs of windows cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([int(a), int(b) + length])
    return [(a, b) for a, b in out]
