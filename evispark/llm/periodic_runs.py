"""Periodic runs: stretches of words that repeat with a period, found by Karp-Miller-Rosenberg names.

Names stand for the word sequences of a power-of-two length, equal names for equal sequences: those of twice the length
come from sorting pairs of names, so nothing is hashed and no suffix is sorted. For each period q a grid of every q-th
word is looked at: a run of three periods covers a whole cell of the grid that equals the next one, which two names tell.
Neighbouring cells are one stretch; common extensions beyond its ends are shorter than q, and descending name levels
give them, one comparison a level. All of it works on the words of many documents at once, in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Documents are searched together up to so many words, grid cells up to so many at once.
WORDS, CELLS = 500_000, 1_000_000


def _doubled(names: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the sequences of 2 * ``width`` words from those of ``width``, and where they start; -1 if none is equal.

    ``names`` ends with ``width`` or more places of -1. A name holds within one document, as the first ones do.
    """
    at = at[names[at + width] >= 0]
    pairs = names[at].astype(np.int64) << 32 | names[at + width]
    return _named(pairs, at, len(names))


def _named(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of ``keys`` at their places, -1 elsewhere and where a key is the only one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    alone = new & np.append(new[1:], True)[: len(ranked)]
    found = np.empty(len(keys), np.int32)
    found[order] = np.where(alone, -1, np.cumsum(new) - 1)
    names = np.full(size, -1, np.int32)
    names[at] = found
    return names, at[found >= 0]


def _repeated(words: np.ndarray, document: np.ndarray, pad: int, width: int) -> np.ndarray:
    """Documents that have a sequence of ``width`` words (a power of two) twice."""
    names, at = _named(document.astype(np.int64) << 32 | words, np.arange(len(words)), len(words) + pad)
    w = 1
    while w < width and len(at):
        names, at = _doubled(names, w, at)
        w *= 2
    return np.unique(document[at])


def _same(names: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    a = names[x]
    return (a >= 0) & (a == names[np.minimum(x + q, len(names) - 1)])


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(document, start, length, period) of every run, sorted, in concatenated documents of ``lengths`` numbered words."""
    if periods < 3:
        raise ValueError("a run needs three periods for a whole cell of the grid")
    none = np.empty((0, 4), np.int64)
    # the part of a run that recurs a period later has least * (1 - 1 / periods) words or more
    width = 1 << max(0, (least - least // periods).bit_length() - 1)
    document = np.repeat(np.arange(len(lengths)), lengths)
    alive = _repeated(words, document, width, width)
    if not len(alive):
        return none
    chosen = np.isin(document, alive)
    words, n = words[chosen], lengths[alive]
    document = np.repeat(np.arange(len(alive)), n)
    begin = np.append(0, np.cumsum(n)[:-1])
    pad = int(n.max()) + 1
    names, at = _named(document.astype(np.int64) << 32 | words, np.arange(len(words)), len(words) + pad)
    levels, found, k = [names], [], 0
    while len(at) and (1 << k) <= pad // periods:
        low, here = 1 << k, np.unique(document[at])
        most = np.minimum(n[here] // periods, 2 * low - 1)
        here, most = here[most >= low], most[most >= low]
        each = most - low + 1  # periods to look at
        d = np.repeat(here, each)
        q = np.arange(len(d)) - np.repeat(np.cumsum(each) - each, each) + low
        cells = n[d] // q - 1
        cut = np.flatnonzero(np.diff(np.cumsum(cells) // CELLS)) + 1
        for a, b in pairwise([0, *cut.tolist(), len(d)]):
            if a < b:
                found.append(_stretches(levels, k, d[a:b], q[a:b], cells[a:b], begin))
        if (2 << k) > pad // periods:
            break
        names, at = _doubled(names, 1 << k, at)
        levels.append(names)
        k += 1
    rows = np.concatenate(found) if found else none
    rows = rows[rows[:, 2] >= np.maximum(least, periods * rows[:, 3])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch with a smaller period appears with its multiples too: the first has the smallest
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))[: len(rows)]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 0] = alive[rows[:, 0]]
    return rows


def _stretches(levels: list[np.ndarray], k: int, d: np.ndarray, q: np.ndarray, cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Maximal stretches of the documents ``d`` that hold a cell equal to the next one, for periods 2^k <= q < 2^(k+1)."""
    pair = np.repeat(np.arange(len(d)), cells)
    j = np.arange(len(pair)) - np.repeat(np.cumsum(cells) - cells, cells)
    period = q[pair]
    i = begin[d][pair] + j * period
    names, w = levels[k], 1 << k
    equal = np.flatnonzero(_same(names, i, period))
    i, period = i[equal], period[equal]
    rest = _same(names, i + period - w, period)
    equal, i, period = equal[rest], i[rest], period[rest]
    pair = pair[equal]
    first = np.append(True, (equal[1:] != equal[:-1] + 1) | (pair[1:] != pair[:-1]))[: len(equal)]
    last = np.append(first[1:], True)[: len(equal)]
    p, pair = period[first], pair[first]
    start, end = i[first], i[last] + period[last]
    for names, w in zip(levels[k::-1], (1 << x for x in range(k, -1, -1)), strict=True):
        back = np.maximum(start - w, 0)
        start = np.where((start >= w) & _same(names, back, p), back, start)
        end = np.where(_same(names, np.minimum(end, len(names) - 1), p), end + w, end)
    return np.stack((d[pair], start - begin[d[pair]], end - start + p, p), 1).astype(np.int64)


def _sliced(texts: list[bytes], most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of successive texts, together up to about ``most`` words, with the number of the first text."""
    at, held, n = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.split())
        n += len(held[-1])
        if n >= most:
            yield at, held
            at, held, n = k + 1, [], 0
    if held:
        yield at, held


def runs_of(texts: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text: its number of words, its runs (start, length, period) and what stays without the repetitions."""
    for _, held in _sliced(texts, WORDS):
        lengths = np.array([len(w) for w in held], np.int64)
        flat = [w for ws in held for w in ws]
        ids = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.empty(0, np.int64)
        rows = find_runs(ids, lengths, least, periods) if flat else np.empty((0, 4), np.int64)
        cut = np.searchsorted(rows[:, 0], np.arange(len(held) + 1))
        for k, ws in enumerate(held):
            own = rows[cut[k] : cut[k + 1], 1:]
            if len(own):
                change = np.zeros(len(ws) + 1, np.int64)
                np.add.at(change, own[:, 0] + own[:, 2], 1)
                np.add.at(change, own[:, 0] + own[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                ws = [ws[x] for x in np.flatnonzero(kept)]
            yield int(lengths[k]), own, b" ".join(ws)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, of
    ``least`` words and ``periods`` (three at least) periods or more, that no neighbouring word extends. Runs are
    sorted by start, then period. ``collapsed`` has the words that no run holds after its first period, joined by one
    blank. Null and empty texts have no words and no runs; rows repeat as they repeat in ``docs``, null ids too; an
    empty table gives no rows; other columns are ignored, whatever their names. Texts are whole: a text of n words
    that keeps repeating takes 4 bytes for each word and name level, of which there are log2(n / periods) or fewer,
    and other texts little. A row is worked on by itself: there is no shuffle.
    """
    kind = docs.schema[id_col].dataType

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            n_words, offsets, runs, kept, at, held = [], [0], [], [], 0, 0
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]

            def made() -> pa.RecordBatch:
                r = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(r[:, c])) for c in range(3)], fields=list(run))
                part = batch.column(0).slice(at, len(n_words))
                columns = [part, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(kept, pa.string())]
                return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

            for n, own, text in runs_of(texts, least, periods):
                n_words.append(n)
                runs.append(own)
                offsets.append(offsets[-1] + len(own))
                kept.append(text)
                held += len(text) + 24 * len(own)
                if held > 32_000_000:
                    yield made()
                    at += len(n_words)
                    n_words, offsets, runs, kept, held = [], [0], [], [], 0
            if n_words:
                yield made()

    rows = spread(docs).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return rows.mapInArrow(found, f"id {kind.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """Of ``runs`` sorted by start and period: the first of those with the most periods, compared exactly; null if there is none."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, strongest run and digests of ``periodic_runs``."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(id_col, "n_runs", "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the words of every text joined by blanks; in a tenth of the texts a tail repeats its first words.

    With h the CRC-32 of the decimal id and g = floor(h / 10): where 10 divides h, the words from g % n on are replaced
    by their first 1 + floor((n - g % n) / (3 + g % 8)), over and over. A null id plants nothing.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  computed once, however often f uses it
    words = F.filter(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(s: Column) -> Column:  # words, first word of the tail, number of words that repeat
        ws, a, p = s["ws"], s["a"], s["p"]
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, at(i))), " ")

    def tail(ws: Column) -> Column:
        a = g % F.size(ws)
        return F.when(F.size(ws) > 0, once(F.struct(ws.alias("ws"), a.alias("a"), (1 + F.floor((F.size(ws) - a) / (3 + g % 8))).alias("p")), repeated))

    text = F.when(h % 10 == 0, once(words, tail)).otherwise(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
