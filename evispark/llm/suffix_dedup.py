"""Suffix-array dedup: repeated byte strings, found by hash-compared suffix sort.

Around every anchor (see ``windows``) the suffixes that start there, and the prefixes that end there read
backwards, are sorted by mergesort. Two of them are compared by the length of their common extension, found
by binary search over polynomial prefix hashes: logarithmically many steps whatever they share. Bytes are then
compared, so a collision of hashes is found and the group sorted by its bytes instead.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .windows import _BASE, Bytes, covered, powers, prefix_hashes, repeated_windows, sliced, with_copies, with_runs

LENGTH, GRAM, CHUNK = 400, 64, 2 << 20


class Suffixes:
    """Places in a buffer, compared by what follows them (``step`` 1) or, backwards, by what precedes (-1)."""

    def __init__(self, buf: bytes, at: np.ndarray, limit: np.ndarray, step: int, hashes: np.ndarray) -> None:
        self.buf, self.u8, self.at, self.limit, self.step, self.p = buf, np.frombuffer(buf, dtype=np.uint8), at, limit, step, hashes
        self.pow = powers(_BASE, len(buf) + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of i and j, by binary search over prefix hashes."""
        x, y, p, pw = self.at[i], self.at[j], self.p, self.pow
        lo, hi = np.zeros(len(i), dtype=np.int64), np.minimum(self.limit[i], self.limit[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            if self.step > 0:
                same = (p[x + mid] - p[x]) * pw[y] == (p[y + mid] - p[y]) * pw[x]
            else:
                same = (p[x] - p[x - mid]) * pw[y - mid] == (p[y] - p[y - mid]) * pw[x - mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as i sorts before, with or after j; an extension that ends sorts first."""
        t, m, n = self.common(i, j), self.limit[i], self.limit[j]
        ended = (t == m) | (t == n)
        last = len(self.u8) - 1
        a = self.u8[np.clip(self.at[i] + t if self.step > 0 else self.at[i] - t - 1, 0, last)].astype(np.int64)
        b = self.u8[np.clip(self.at[j] + t if self.step > 0 else self.at[j] - t - 1, 0, last)].astype(np.int64)
        return np.sign(np.where(ended, m - n, a - b))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """A permutation that sorts each group: bottom-up mergesort, all merges of a level at once."""
        n = len(group)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, n])
        base, total = np.repeat(start, size), np.repeat(size, size)
        r, perm, w = np.arange(n) - base, np.arange(n), 1
        while w < size.max(initial=0):
            block = r // w
            sibling = (block ^ 1) * w
            live = np.flatnonzero(sibling < total)
            first = base[live] + sibling[live]
            lo, hi = first.copy(), base[live] + np.minimum(sibling[live] + w, total[live])
            right, item = (block[live] & 1) == 1, perm[live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.before(perm[mid], item[open_])
                less = (c < 0) | ((c == 0) & right[open_])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            to = np.arange(n)
            to[live] = base[live] + (block[live] & ~1) * w + (r[live] - block[live] * w) + (lo - first)
            merged = np.empty_like(perm)
            merged[to] = perm
            perm, w = merged, 2 * w
        return perm

    def text(self, i: int) -> bytes:
        x, m = int(self.at[i]), int(self.limit[i])
        return self.buf[x : x + m] if self.step > 0 else self.buf[x - m : x][::-1]


def common_bytes(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def sorted_groups(s: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order and the common extension of each with the one before it, verified by bytes."""
    perm = s.sort(group)
    common = np.zeros(len(perm), dtype=np.int64)
    if len(perm) > 1:
        common[1:] = s.common(perm[:-1], perm[1:])
    common[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] = 0
    wrong = set()
    for k in np.flatnonzero(common):
        t, x, y = int(common[k]), int(s.at[perm[k - 1]]), int(s.at[perm[k]])
        same = s.buf[x : x + t] == s.buf[y : y + t] if s.step > 0 else s.buf[x - t : x] == s.buf[y - t : y]
        if not same:
            wrong.add(int(group[k]))
    for g in wrong:  # hashes collided: the bytes decide
        rows = np.flatnonzero(group == g)
        by_bytes = sorted(rows.tolist(), key=s.text)
        perm[rows] = by_bytes
        common[rows] = [0, *(common_bytes(s.text(a), s.text(b)) for a, b in zip(by_bytes, by_bytes[1:], strict=False))]
    return perm, common


def match_suffixes(group: np.ndarray, ctxs: list[bytes], a: np.ndarray, ords: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """Windows of each context that another context of its group has at the same offset from the anchor.

    Groups of sorted suffixes are joined in the order of falling common extensions. When two are joined, each
    of the smaller meets its two neighbours, by sorted prefixes, in the larger: any other there shares no more
    on either side than the neighbour between does with it. So the pairs are n log n and no window is missed.
    """
    buf = b"".join(ctxs)
    sizes = np.array([len(c) for c in ctxs], dtype=np.int64)
    a = np.asarray(a, dtype=np.int64)
    at = np.cumsum(sizes) - sizes + a
    hashes = prefix_hashes(Bytes().hashes(buf))
    perm, common = sorted_groups(Suffixes(buf, at, sizes - a, 1, hashes), group)
    left_perm, _ = sorted_groups(Suffixes(buf, at, a, -1, hashes), group)
    rank = np.empty(len(perm), dtype=np.int64)
    rank[left_perm] = np.arange(len(perm))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
    place, most = a.tolist(), 0
    for lo, hi in zip(starts, [*starts[1:], len(perm)], strict=True):
        if hi - lo < 2:
            continue
        most = max(place[i] for i in perm[lo:hi].tolist())
        sets = {k: [int(rank[perm[k]])] for k in range(lo, hi)}  # by first place of an interval
        first, last = {k: k for k in sets}, {k: k for k in sets}  # of the interval that ends, or begins, at a place
        for k in sorted(range(lo + 1, hi), key=lambda k: -common[k]):
            r = int(common[k])
            if r + most < length:
                break
            x, y = first[k - 1], k
            small, large = sorted((sets.pop(x), sets.pop(y)), key=len)
            for u in small:
                p = bisect_left(large, u)
                for v in large[max(0, p - 1) : p + 1]:
                    i, j = int(left_perm[u]), int(left_perm[v])
                    back = common_bytes(ctxs[i][: place[i]][::-1], ctxs[j][: place[j]][::-1])
                    if back + r >= length:
                        yield i, place[i] - back, place[i] + r - length
                        yield j, place[j] - back, place[j] + r - length
            for u in small:
                insort(large, u)
            sets[x] = large
            end = last[y]
            first[end], last[x] = x, end


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, **more) -> DataFrame:
    """Per row of ``docs``: row_no, id, ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed``, ``spans``, ``n_shared``.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in any document or this
    one, goes; strings are judged on the input. ``spans`` are the maximal removed stretches (start, end).
    ``n_shared`` tells of shared passages too short to go: of the ``gram``-byte strings that stand for the
    document (the anchors, at least one in ``length`` bytes), how many another document has as an anchor.

    Defined results: null text is empty and keeps its no bytes; texts shorter than ``length`` stay whole;
    repeated rows remove each other; an empty table gives no rows; null ids stay null; other columns are ignored.
    Texts are whole, however long: a task holds one with its hashes (some 100 bytes a byte, at most 4 MB of it at
    once); one that repeats itself, as a run of one byte does, is compared by its first period alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def runs() -> DataFrame:
        ordered = rows.withColumn("ord", F.col("row_no"))
        return repeated_windows(ordered, Bytes, lambda g, c, a, o: match_suffixes(g, c, a, o, length), length, gram, False, chunk, **more)

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            out = []
            for row, doc, t, first, last, shared, copies in zip(*(batch[c] for c in ("row_no", "id", "t", "first", "last", "n_shared", "copies")), strict=True):
                b = t.encode("utf-8", "surrogatepass")
                spans = covered(*with_copies(first, last, copies, True), length)
                kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
                out.append((row, doc, kept, len(b), len(b) - len(kept), [{"start": x, "end": y} for x, y in spans], 0 if pd.isna(shared) else int(shared)))
            yield pd.DataFrame(out, columns=["row_no", "id", "kept", "n_bytes", "n_removed", "spans", "n_shared"])

    schema = f"row_no long, id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, n_shared long"
    return with_runs(rows, runs).mapInPandas(removed, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
