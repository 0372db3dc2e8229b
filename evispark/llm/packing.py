"""Best-fit packing: documents as token pieces into sequences of a fixed capacity.

Bulk-synchronous best fit. In each round the pieces that wait and the gaps (room left in sequences) are range-sorted
by size, and a sweep from the largest down matches pieces with the next gaps that hold them; ranks decide who of
several sizes gets which gaps. Then the gaps shrink and the sweep repeats; once nothing moves, sequences are opened for
the largest pieces. Sizes are at most the capacity, so a row of a round stands for all pieces of a size or a run of
gaps of a room: the rounds' tables are bounded by the capacity and not by the corpus. Documents themselves are only
ranked within their size and looked up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from struct import pack as pack_ids

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, materialise, numbered, rank_within, settled
from .token_counts import byte_alphabet

CAPACITY = 2048
#: Documents in order that are packed together, so that their order holds from one such window to the next.
WINDOW = 4096
#: White-space-separated chunks whose ids a worker remembers before it forgets them all.
REMEMBERED = 250_000
#: Fixed patterns: how the tokenizer file splits lower-cased text, and the chunks for which that is all it does
#: (printable ASCII and the composed letters of Latin-1, which its normalization leaves alone).
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


class ChunkTokenizer:
    """A tokenizer that drops white space and never joins across it: ids of a text, chunk by chunk, remembered.

    New plain chunks without the marks of special tokens are split into words, remembered too, that go straight
    to the tokenizer's model; other chunks pass the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()

    def _word(self, w: str) -> bytes:
        shown = w if w.isascii() else "".join([self.alphabet[b] for b in w.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        found = self.words[w] = pack_ids(f"<{len(ids)}I", *ids)
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        rest, known, words, plain, split, word = [], self.known, self.words, PLAIN.fullmatch, SPLIT.findall, self._word
        for c in chunks:
            if c.isalpha():  # ASCII letters only: one word
                w = c.lower().decode()
                known[c] = words.get(w) or word(w)
                continue
            w = c.decode()
            if plain(w) and "<|" not in w:
                parts = split(w.lower())
                known[c] = b"".join([words.get(p) or word(p) for p in parts]) if len(parts) > 1 else words.get(parts[0]) or word(parts[0])
            else:
                rest.append(c)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False), strict=True):
                known[c] = pack_ids(f"<{len(e.ids)}I", *e.ids)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        split = [t.encode("utf-8").split() for t in texts]
        self._learn(list(set().union(*split).difference(known)))
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", row_no: Column | None = None) -> DataFrame:
    """Per piece: row_no, id, piece, start, length, ids_crc32. A document's ids end with a 0; null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = ChunkTokenizer(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                out = []
                for row, doc, ids in zip(part["row_no"], part["id"], made.ids(part["t"].tolist()), strict=True):
                    ids += b"\0\0\0\0"
                    for k in range(0, len(ids), 4 * capacity):
                        b = ids[k : k + 4 * capacity]
                        out.append((row, doc, k // (4 * capacity), k // 4, len(b) // 4, zlib.crc32(b)))
                yield pd.DataFrame(out, columns=["row_no", "id", "piece", "start", "length", "ids_crc32"])
        made.known.clear()  # a worker that waits for its next task holds no tokenizer
        made.words.clear()
        del made

    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")]
    rows = numbered(docs, *columns) if row_no is None else docs.select(row_no.alias("row_no"), *columns)
    return rows.mapInPandas(cut, f"row_no long, id {kind}, piece int, start long, length long, ids_crc32 long")


#: What a row of a round's table is: pieces of a size that wait, gaps of a room, pieces put into gaps, gaps just shrunk.
WAITING, GAP, PUT, SHRUNK = range(4)
ROW = "kind int, size long, first long, n long, sequence long, offset long"
#: Rows that one task sweeps; more are dealt out by ranges of sizes.
SWEPT = 1024


def sweep(rows: list[tuple], capacity: int) -> list[tuple]:
    """One sweep over rows (kind, size, first, n, …) of waiting pieces and gaps, sorted by falling size, gaps first.

    Pieces take the nearest gaps that hold them, which are the smallest, as many of a size in a gap as fit; where sizes
    compete for gaps the larger have the first ranks. Rows of the same form come back: what was put (ranks of a size,
    one into each of n sequences), what still waits, gaps untouched and gaps shrunk.
    """
    gaps: list[list[int]] = []  # room, first sequence, sequences; the smallest room last
    out: list[tuple] = []
    for kind, size, first, n, *_ in rows:
        if kind == GAP:
            gaps.append([size, first, n])
            continue
        while n and gaps:
            room, sequence, there = gaps[-1]
            per = room // size
            took = min(there, n // per)
            if not took:
                took, per = 1, n
            out += [(PUT, size, first + k * took, took, sequence, capacity - room + k * size) for k in range(per)]
            if room > per * size:
                out.append((SHRUNK, room - per * size, sequence, took, 0, 0))
            first, n = first + took * per, n - took * per
            gaps[-1][1:] = sequence + took, there - took
            if took == there:
                gaps.pop()
        if n:
            out.append((WAITING, size, first, n, 0, 0))
    return out + [(GAP, room, sequence, n, 0, 0) for room, sequence, n in gaps]


def to_open(waiting: dict[int, int], widest: int, capacity: int) -> int:
    """How many sequences to open for waiting pieces {size: n} when the widest gap left is ``widest``.

    Only for those of the larger half of sizes that no gap can hold any more: one for each piece of more than half a
    sequence, else as many as their tokens fill. So no gap is opened that smaller pieces could have done without.
    """
    least = max(max(waiting, default=0) // 2, widest)
    these = {s: n for s, n in waiting.items() if s > least}
    alone = sum(n for s, n in these.items() if 2 * s > capacity)
    return max(alone, max(1, sum(s * n for s, n in these.items()) // capacity)) if these else 0


def _order(row: tuple) -> tuple:
    return -row[1], -row[0], row[2]


def sweeps(rows: list[tuple], capacity: int) -> list[tuple]:
    """Sweeps, each over what the one before has left, until one puts nothing."""
    out: list[tuple] = []
    while True:
        swept = sweep(sorted(rows, key=_order), capacity)
        put = [r for r in swept if r[0] == PUT]
        rows = [(GAP, *r[1:]) if r[0] == SHRUNK else r for r in swept if r[0] != PUT]
        if not put:
            return out + rows
        out += put


def _opening(rows: list[tuple], capacity: int, opened: int) -> tuple[int, int] | None:
    """The number of sequences to open, and then open, for rows (kind, size, first, n, …); none if no piece waits."""
    waiting: Counter = Counter()
    for r in rows:
        waiting.update({r[1]: r[3]} if r[0] == WAITING else {})
    more = to_open(waiting, max((r[1] for r in rows if r[0] == GAP), default=0), capacity)
    return (more, opened + more) if waiting else None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The schedule, made in one place. Runs (size, first rank, ranks, first sequence, offset): rank ``first + i`` goes to sequence ``first sequence + i``."""
    rows, out, opened = [(WAITING, s, 0, n, 0, 0) for s, n in counts.items() if n], [], 0
    while True:
        swept = sweeps(rows, capacity)
        out += [r[1:] for r in swept if r[0] == PUT]
        rows = [r for r in swept if r[0] != PUT]
        found = _opening(rows, capacity, opened)
        if not found:
            return out
        more, now = found
        rows.append((GAP, capacity, opened, more, 0, 0))
        opened = now


def _swept(rows: DataFrame, n_rows: int, capacity: int, at_once: int) -> DataFrame:
    """A round: ranges of sizes, of ``at_once`` rows each, are swept by a task each, then what they have left, which is
    nearest across them. Where all rows make one range, it is swept until nothing moves.
    """

    def by(f: Callable[[list[tuple], int], list[tuple]]) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = [r for b in batches for r in zip(*(b[c].tolist() for c in b.columns), strict=True)]
            yield pd.DataFrame(f(sorted(part, key=_order), capacity), columns=[c.split()[0] for c in ROW.split(", ")])

        return run

    if n_rows <= at_once:
        return rows.coalesce(1).mapInPandas(by(sweeps), ROW)
    ranges = materialise(rows.repartitionByRange(-(-n_rows // at_once), F.desc("size")).mapInPandas(by(sweep), ROW))
    open_ = F.col("kind").isin(WAITING, GAP)
    return ranges.where(~open_).unionByName(ranges.where(open_).coalesce(1).mapInPandas(by(sweep), ROW))


def best_fit_rounds(counts: DataFrame, capacity: int = CAPACITY, at_once: int = SWEPT) -> DataFrame:
    """The schedule of ``best_fit`` for pieces counted by size (length, n), as a table.

    A round is a Spark job: rows are range-sorted by size and swept, gaps are updated and written. The tables have a row
    per size that waits and per run of gaps, whose number the capacity bounds. Once a round puts nothing the driver,
    which sees the rows that are left, opens sequences for the largest pieces.
    """
    spark, zero = counts.sparkSession, F.lit(0).cast("long")
    rows = counts.select(F.lit(WAITING).alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", zero.alias("sequence"), zero.alias("offset"))
    n_rows, opened, put = capacity, 0, []
    while True:
        table = materialise(_swept(rows, n_rows, capacity, at_once))
        put.append(table.where(F.col("kind") == PUT))
        rows = table.where(F.col("kind") != PUT).withColumn("kind", F.when(F.col("kind") == SHRUNK, GAP).otherwise(F.col("kind")))
        left = [tuple(r) for r in rows.collect()]  # bounded by the capacity, see above
        again, n_rows = n_rows > at_once and bool(put[-1].take(1)), len(left) + 1
        if again:
            continue
        found = _opening(left, capacity, opened)
        if not found:
            return reduce(DataFrame.unionByName, put)
        new = dict(zip(rows.columns, (GAP, capacity, opened, found[0], 0, 0), strict=True))
        rows = rows.unionByName(spark.range(1).select(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in new.items())))
        opened = found[1]


def _plan(put: DataFrame, *keys: str) -> DataFrame:
    """A row per size (and key): its runs (first rank, first sequence, offset), by rank."""
    return put.groupBy(*keys, F.col("size").alias("length")).agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "offset"))).alias("runs"))


def _placed() -> tuple[Column, Column]:
    """Sequence and offset of a piece by its ``rank`` among those of its size and the size's ``runs``."""
    run = F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("rank")), -1)
    return run["sequence"] + F.col("rank") - run["first"], run["offset"]


def _public() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset; no other columns of ``docs``.

    ``tokenizer`` is a path that exists on every executor (by default that of the installed public
    tokenizers). Only documents longer than ``capacity`` are cut. Texts stay where they are read: only a row of
    numbers per piece is written and shuffled, and a size that many pieces have is ranked in buckets.

    Defined results: a null or empty text is one piece of length 1 (the id 0); rows repeat as they repeat in
    ``docs``; null ids stay null; an empty table gives no rows.
    """
    found = materialise(pieces(docs, tokenizer or _public(), capacity, id_col, text_col))
    counts = found.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    plan = settled(lambda: _plan(best_fit_rounds(counts, capacity)))
    ranked = rank_within(found, ["length"], ["row_no", "piece"], found.count(), "rank").join(F.broadcast(plan), "length")  # at most ``capacity`` rows
    sequence, offset = _placed()
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def written_order(docs: DataFrame) -> DataFrame:
    """``docs``, just read from Parquet files, with ``__position``: 0, 1, ... in the order that they were written in.

    Other columns stay, whatever their names; one named ``__position`` is replaced. An empty table gives no rows.
    """
    meta = docs.metadataColumn("_metadata")
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "__position"))
    file, index, base = (fresh(docs, x) for x in ("__file", "__index", "__base"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    of = docs.select(*columns, meta["file_name"].alias(file), meta["row_index"].alias(index))
    part = F.regexp_extract(file, r"part-([0-9]+)", 1).try_cast("long")  # a row per file: few
    sizes = of.groupBy(file).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.coalesce(part, F.lit(-1).cast("long")))
    before = Window.orderBy("part", file).rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    places = checked_broadcast(materialise(places))
    return of.join(places, file).select(*columns, (F.col(base) + F.col(index)).alias("__position"))


def pack_in_order(docs: DataFrame, position_col: str, tokenizer: str | None = None, capacity: int = CAPACITY, window: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``pack``, for documents with places 0, 1, ... in an order that the sequences keep.

    Each window of documents is best-fit packed by itself, by order among pieces of one size, and its sequences are
    numbered by their first pieces after those of the windows before: the first n windows' documents fill the first
    sequences, whatever n. Schedules are made on the executors, a window each.

    Defined results: as in ``pack``; documents at one place (ties) are packed in any order of their pieces' ranks, a
    null place is an error of the caller's; other columns are ignored. Texts are whole, however long.
    """
    tokenizer, window = tokenizer or _public(), window or WINDOW
    found = materialise(pieces(docs, tokenizer, capacity, id_col, text_col, F.col(position_col)))
    found = found.withColumn("window", F.floor(F.col("row_no") / window).cast("long"))
    counts = found.groupBy("window", "length").agg(F.count(F.lit(1)).alias("n"))

    def planned(part: pd.DataFrame) -> pd.DataFrame:  # at most ``capacity`` rows
        put = best_fit(dict(zip(part["length"].tolist(), part["n"].tolist(), strict=True)), capacity)
        out = pd.DataFrame(put, columns=["size", "first", "n", "sequence", "offset"])
        return out.assign(window=part["window"].iloc[0])

    put = counts.groupBy("window").applyInPandas(planned, "size long, first long, n long, sequence long, offset long, window long")
    plan = materialise(_plan(put, "window"))
    rank = F.row_number().over(Window.partitionBy("window", "length").orderBy("row_no", "piece")) - 1
    placed = found.withColumn("rank", rank.cast("long")).join(plan, ["window", "length"])
    sequence, offset = _placed()
    placed = placed.select("window", "row_no", "id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence"), offset.alias("offset"))
    first = F.min(F.struct("row_no", "piece")).over(Window.partitionBy("window", "sequence"))
    placed = materialise(placed.withColumn("first", first))
    placed = placed.withColumn("at", F.dense_rank().over(Window.partitionBy("window").orderBy("first")) - 1)
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    opened = placed.groupBy("window").agg((F.max("sequence") + 1).alias("n"))  # a row per window
    opened = opened.select("window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(checked_broadcast(materialise(opened)), "window").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).cast("long").alias("sequence_id"), "offset"
    )
