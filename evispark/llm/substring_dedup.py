"""Substring dedup: word windows that an earlier document has, found by backward search in FM-indexes.

A shard holds the contexts of whole anchor groups (see ``windows``). Its FM-index is the Burrows-Wheeler
transform of their words in a wavelet matrix of packed bits. Each context is streamed against it from its end
to its start: backward search extends a match while some earlier document has it, which gives the longest
earlier match for an end; matches of a window or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .windows import Words, covered, repeated_windows, sliced, with_copies, with_runs

LENGTH, GRAM, CHUNK = 50, 12, 5 << 19
#: A failed match is tried again from so many words beyond the word it failed at, to skip the ends between.
PROBE = 8
LATEST = (1 << 63) - 1


class WaveletMatrix:
    """Rank queries over a sequence of small numbers: a bit per number and level, and a count per 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        s, n = seq, len(seq)
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            packed = np.zeros(-(-(n + 1) // 64) * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            one = bit.astype(bool)
            self.zeros.append(n - int(one.sum()))
            s = np.concatenate((s[~one], s[one]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & below)
            i = np.where((c >> (self.levels - 1 - k)) & 1, ones + self.zeros[k], i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i numbers are c."""
        return self._down(c, i) - self.start[c]


def sorted_suffixes(seq: np.ndarray, upto: int) -> np.ndarray:
    """Suffixes sorted by their first ``upto`` numbers at least (prefix doubling)."""
    n, h = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        if h >= upto or (n and rank.max() == n - 1):
            return np.argsort(rank, kind="stable")
        after = np.zeros(n, dtype=np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        h *= 2


class FMIndex:
    """Backward search over a sequence whose places have an order; patterns of up to ``upto`` numbers."""

    def __init__(self, seq: np.ndarray, sigma: int, order: np.ndarray, upto: int) -> None:
        sa = sorted_suffixes(seq, upto)
        self.n = len(seq)
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))][:-1]
        self.bwt = WaveletMatrix(seq[sa - 1], sigma)
        self.least = [order[sa]]  # least order of each 2 ** k places
        while 2 ** len(self.least) <= self.n:
            x, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), np.iinfo(np.int32).max, dtype=np.int32)
        some = np.flatnonzero(hi > lo)
        k = np.frexp((hi - lo)[some])[1] - 1
        for level in np.unique(k):
            at = some[k == level]
            out[at] = np.minimum(self.least[level][lo[at]], self.least[level][hi[at] - 2**level])
        return out


def match_backward(group: np.ndarray, ctxs: list[bytes], a: np.ndarray, ords: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """Windows of each context that a context of a smaller order has (anywhere in the shard)."""
    words = [c.split(b" ") for c in ctxs]
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    flat: list[bytes] = []
    for w in words:
        flat += w
        flat.append(b"")  # no word is empty: it parts the contexts
    codes, names = pd.factorize(np.array(flat, dtype=object))
    end_code = int(np.flatnonzero(np.array([x == b"" for x in names]))[0])
    seq = codes.astype(np.int64)
    _, dense = np.unique(np.asarray(ords), return_inverse=True)
    order = np.repeat(dense, sizes).astype(np.int32)
    order[seq == end_code] = np.iinfo(np.int32).max
    index = FMIndex(seq, len(names), order, length + 14)
    start = np.cumsum(sizes) - sizes
    least = pd.Series(dense).groupby(np.asarray(group)).transform("min").to_numpy()
    i = np.flatnonzero(dense > least)  # the earliest context of a group has nothing before it
    s, mine = start[i], dense[i]
    end = s + sizes[i] - 1
    at = end.copy()
    lo, hi = np.zeros(len(i), dtype=np.int64), np.full(len(i), index.n, dtype=np.int64)
    failed, back_to = np.full(len(i), -1, dtype=np.int64), np.zeros(len(i), dtype=np.int64)  # of a probe: place, end to return to
    live = np.flatnonzero(end - s >= length)
    while len(live):
        b = at[live]
        inside = b > s[live]
        c = seq[np.maximum(b - 1, 0)]
        lo2, hi2 = index.extend(c, lo[live], hi[live])
        # a match longer than the suffixes are sorted by can't be relied on: it is cut there and goes on from its overlap
        good = inside & (index.earliest(lo2, hi2) < mine[live]) & (end[live] - b < length + 14)
        go = live[good]
        at[go], lo[go], hi[go] = b[good] - 1, lo2[good], hi2[good]
        passed = go[(failed[go] >= 0) & (at[go] <= failed[go])]  # a probe that passes: the ends between do count
        end[passed] = back_to[passed] - 1
        stop = live[~good]
        probing = failed[stop] >= 0
        matched = end[stop] - at[stop]
        found = stop[(matched >= length) & ~probing]
        for k in found:
            yield int(i[k]), int(at[k] - s[k]), int(end[k] - length - s[k])
        nxt = end[stop] - 1
        full = (matched >= length) & ~probing
        nxt[full] = np.minimum(nxt[full], at[stop][full] + length - 1)
        at_start = at[stop] == s[stop]
        f = at[stop] - 1
        probe = ~probing & ~full & ~at_start & (end[stop] - f > PROBE + 1)
        back_to[stop[probe]] = end[stop[probe]]
        failed[stop] = np.where(probe, f, -1)
        nxt[probe] = f[probe] + PROBE
        nxt[~probing & at_start] = s[stop][~probing & at_start]  # nothing further back
        end[stop] = nxt
        failed[passed] = -1
        fresh = np.concatenate((stop, passed))
        at[fresh], lo[fresh], hi[fresh] = end[fresh], 0, index.n
        over = (end[live] - s[live] < length) & (failed[live] < 0)
        live = live[~over]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, **more) -> DataFrame:
    """Per row of ``docs``: row_no, id, ``kept`` (the words that stay, joined by a space), ``n_words``, ``n_removed``.

    A window is ``length`` words in a row. Words covered by a window that also starts in a document with a
    smaller id go; windows are judged on the input. The id must be a whole number.

    Defined results: null text has no words; texts shorter than a window stay whole; null ids come after all
    others; rows with one id aren't earlier than each other; an empty table gives no rows; other columns are ignored.
    Texts are whole, however long; one that repeats itself is compared by its first period alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def runs() -> DataFrame:
        ordered = rows.withColumn("ord", F.coalesce(F.col("id").cast("long"), F.lit(LATEST)))
        return repeated_windows(ordered, Words, lambda g, c, a, o: match_backward(g, c, a, o, length), length, gram, True, chunk, **more)

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            out = []
            for row, doc, t, first, last, copies in zip(*(batch[c] for c in ("row_no", "id", "t", "first", "last", "copies")), strict=True):
                w = t.encode("utf-8", "surrogatepass").split()
                spans = covered(*with_copies(first, last, copies, False), length)
                kept = [x for p, q in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(w)], strict=True) for x in w[p:q]]
                out.append((row, doc, b" ".join(kept).decode("utf-8", "surrogatepass"), len(w), len(w) - len(kept)))
            yield pd.DataFrame(out, columns=["row_no", "id", "kept", "n_words", "n_removed"])

    schema = f"row_no long, id {kind}, kept string, n_words long, n_removed long"
    return with_runs(rows, runs).mapInPandas(removed, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
