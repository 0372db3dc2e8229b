"""Alignment of two tokenizers: where both end a token, and which tokens stand for the same bytes.

The tokens of a whole batch of documents are laid end to end by their bytes: one bincount of the ends of each tokenizer
tells where both end, there the bytes are cut into groups, and prefix sums of cuts and tokens give every document's
counts. Each token of a group is linked with each of the other tokenizer's tokens in it.

How many documents hold a link is counted over the corpus. A batch knows its distinct links and which of its documents
hold them how often (a sparse matrix, written); the links of all batches are counted by a shuffle, each batch gets back
the counts of its own links, and the matrix turns them into sums of its documents. So what is shuffled is a row for each
batch and distinct link, and no table of links is held by a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, settled, spread
from .token_counts import byte_alphabet

#: Characters of text that make a batch.
BATCH = 4_000_000
#: Characters of a batch that are worked on at once; longer documents are cut up at ends of words.
STEP = 400_000
#: Segments whose ids a worker remembers before it forgets them all.
REMEMBERED = 100_000
#: Groups with more links than this are counted by their distinct ids.
WIDE = 4096
#: No token of either kind goes over a space or line feed that follows anything but white space.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
SPACES = re.compile(r"\s[ \n]")


def segments(text: str) -> list[str]:
    """``text``, which starts with a space, cut before each space or line feed that doesn't follow white space."""
    if "\0" in text or SPACES.search(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


class ByteTokens:
    """A byte-level vocabulary whose ids are in the order of its merges: ids by rank, entries as bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = {i: bytes(byte_of[c] for c in entry) for entry, i in model["vocab"].items() if all(c in byte_of for c in entry)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(p)] for p in pairs]
        if any(x >= y for x, y in pairwise(merged)):
            raise ValueError(f"{path}: the ids aren't in the order of the merges")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(s) for s in parts]


class PieceTokens:
    """A piece vocabulary with byte fallback, which puts a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError(f"{path}: pieces go over spaces")
        self.space = model.piece_to_id("▁")
        shown = lambda i, p: bytes([int(p[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode()
        self.bytes = {i: shown(i, p) for i, p in enumerate(pieces)}

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that start with a space or a line feed, as they are in a text: the space put before a line feed goes."""
        found = self.model.encode([s[1:] if s[0] == " " else s for s in parts], num_threads=1)
        return [ids[1:] if s[0] != " " else ids or [self.space] for s, ids in zip(parts, found, strict=True)]


@dataclass
class Tokens:
    """Ids of both tokenizers, document by document, and how many each document has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


@dataclass
class Groups:
    """The groups of ``Tokens``: the group of each token, the groups of each document, the first tokens of each group and one more."""

    a: np.ndarray
    b: np.ndarray
    per_document: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray


class Aligner:
    """Both tokenizers with the lengths of their tokens; ids of segments are remembered."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.tokenizers = ByteTokens(a_path), PieceTokens(b_path)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.lengths, self.listed = [], []
        for t in self.tokenizers:
            size = max(t.bytes) + 1
            n = np.zeros(size, np.int64)
            n[list(t.bytes)] = [len(x) for x in t.bytes.values()]
            self.lengths.append(n)
            # decimal ids as rows of bytes, filled up with zeros; the last column is for what follows
            self.listed.append(np.array([str(i).encode() for i in range(size)], f"S{len(str(size)) + 1}").view(np.uint8).reshape(size, -1))
        self.digits = [(x > 0).sum(1) for x in self.listed]
        self.odd: set[str] = set()

    def _learn(self, parts: Iterable[str]) -> None:
        new = [*parts]
        for t, known in zip(self.tokenizers, self.known, strict=True):
            for at in range(0, len(new), 50_000):
                some = new[at : at + 50_000]
                for s, ids in zip(some, t.encode(some), strict=True):
                    known[s] = np.array(ids, "<u4").tobytes()
                    if b"".join([t.bytes[i] for i in ids]) != s.encode("utf-8", "surrogatepass"):
                        self.odd.add(s)

    def _whole(self, parts: list[str]) -> bool:
        """Whether the bytes of both tokenizers' tokens, joined, are those of the parts."""
        want = "".join(parts).encode("utf-8", "surrogatepass")
        return all(b"".join([t.bytes[i] for s in parts for i in np.frombuffer(known[s], "<u4").tolist()]) == want for t, known in zip(self.tokenizers, self.known, strict=True))

    def tokens(self, documents: list[list[str]]) -> Tokens:
        """Ids of documents given as segments; none where the bytes aren't the text's."""
        known_a, known_b = self.known
        if len(known_a) > REMEMBERED:
            known_a.clear(), known_b.clear(), self.odd.clear()
        self._learn({s for parts in documents for s in parts if s not in known_a})
        if self.odd:
            documents = [[] if any(s in self.odd for s in parts) and not self._whole(parts) else parts for parts in documents]
        a, b = ([b"".join([known[s] for s in parts]) for parts in documents] for known in self.known)
        ids = lambda x: np.frombuffer(b"".join(x), "<u4").astype(np.int64)
        count = lambda x: np.array([len(y) // 4 for y in x], np.int64)
        return Tokens(ids(a), ids(b), count(a), count(b))

    def groups(self, t: Tokens) -> Groups:
        ends = [np.cumsum(n[ids]) for n, ids in zip(self.lengths, (t.a, t.b), strict=True)]
        total = int(ends[0][-1]) if len(t.a) else 0
        cut = np.bincount(ends[0], minlength=total + 1).astype(bool) & np.bincount(ends[1], minlength=total + 1).astype(bool)
        so_far = np.cumsum(cut, dtype=np.int32)
        a, b = (so_far[e] - cut[e] for e in ends)
        n = int(so_far[-1])
        last = np.append(0, so_far[np.append(0, ends[0])[np.cumsum(t.n_a)]])
        first_a, first_b = (np.append(0, np.cumsum(np.bincount(g, minlength=n))) for g in (a, b))
        return Groups(a, b, np.diff(last), first_a, first_b)

    def listings(self, t: Tokens, g: Groups) -> list[bytes]:
        """Each document's groups: ``a1,a2|b1;a3|b2``."""
        n_a, n_b = len(t.a), len(t.b)
        place = np.arange(n_a) + g.first_b[g.a], np.arange(n_b) + g.first_a[g.b + 1]
        width = max(x.shape[1] for x in self.listed)
        shown, size = np.zeros((n_a + n_b, width), np.uint8), np.empty(n_a + n_b, np.int64)
        for ids, of, at, last, listed, digits in zip((t.a, t.b), (g.a, g.b), place, b"|;", self.listed, self.digits, strict=True):
            shown[at, : listed.shape[1]] = listed[ids]
            size[at] = digits[ids] + 1
            shown[at, digits[ids]] = np.where(np.append(of[1:] == of[:-1], False)[: len(of)], ord(","), last)
        text = shown[shown > 0].tobytes()
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(t.n_a + t.n_b))]
        return [text[x : y - 1] if y > x else b"" for x, y in pairwise(upto.tolist())]

    def links(self, t: Tokens, g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, a, b, times) of every distinct link of each document, sorted."""
        n_a, n_b = np.diff(g.first_a), np.diff(g.first_b)
        of = np.repeat(np.arange(len(g.per_document)), g.per_document)
        size_b = len(self.lengths[1])
        size = len(self.lengths[0]) * size_b
        wide = n_a * n_b > WIDE
        some = np.flatnonzero(~wide[g.a]) if wide.any() else np.arange(len(t.a))
        group = g.a[some]
        each = n_b[group]
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        keys = np.repeat((of[group] * size) + t.a[some] * size_b, each) + t.b[np.repeat(g.first_b[group], each) + nth]
        keys.sort()
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        keys, times = keys[new], np.diff(np.append(new, len(keys)))
        if wide.any():
            more = []
            for x in np.flatnonzero(wide):
                (p, n_p), (q, n_q) = (np.unique(ids[first[x] : first[x + 1]], return_counts=True) for ids, first in ((t.a, g.first_a), (t.b, g.first_b)))
                more.append(((of[x] * size + (p * size_b)[:, None] + q).ravel(), np.multiply.outer(n_p, n_q).ravel()))
            keys, times = summed(np.concatenate([keys, *(k for k, _ in more)]), np.concatenate([times, *(n for _, n in more)]))
        document, pair = np.divmod(keys, size)
        return document, *np.divmod(pair, size_b), times


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, and the sum of its times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[new], np.add.reduceat(times, new) if len(new) else times


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as their steps, byte plane by byte plane, compressed."""
    steps = np.diff(x.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(steps).tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


def _batches(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Documents in batches of about ``BATCH`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def _steps(documents: Iterable[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Pieces of documents, as their document's place and segments, about ``STEP`` characters at a time."""
    size, held, n = min(STEP, BATCH), [], 0
    for d, t in enumerate(documents):
        parts = segments(" " + t) if t else []
        step = max(1, len(parts) * size // max(size, len(t or "")))
        for k in range(0, len(parts), step):
            held.append((d, parts[k : k + step]))
            n += sum(map(len, held[-1][1]))
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


class Batch:
    """What a batch of documents gives: counts and digests of each, and the links that each holds."""

    def __init__(self, aligner: Aligner, documents: list[str | None]) -> None:
        n = len(documents)
        self.counts = np.zeros((4, n), np.int64)  # tokens of both kinds, groups, links
        digests: list = [None] * n
        gone = np.zeros(n, bool)  # documents with a piece whose bytes aren't the text's
        keys, size_b = [], len(aligner.lengths[1])
        size = len(aligner.lengths[0]) * size_b
        for now in _steps(documents):
            t = aligner.tokens([piece for _, piece in now])
            g = aligner.groups(t)
            of = np.array([d for d, _ in now])
            gone[of[t.n_a == 0]] = True
            np.add.at(self.counts, (slice(None), of), np.stack((t.n_a, t.n_b, g.per_document, np.zeros(len(now), np.int64))))
            for d, listing in zip(of.tolist(), aligner.listings(t, g), strict=True):
                if listing:
                    if digests[d]:
                        digests[d].update(b";" + listing)
                    else:
                        digests[d] = hashlib.sha256(listing)
            document, a, b, times = aligner.links(t, g)
            keys.append((of[document] * size + a * size_b + b, times))
        found, self.times = summed(*(np.concatenate(x) for x in zip(*keys, strict=True))) if len(keys) > 1 else keys[0] if keys else (np.empty(0, np.int64),) * 2
        self.counts[:, gone] = 0
        document, pair = np.divmod(found, size)
        if gone.any():
            document, pair, self.times = (x[~gone[document]] for x in (document, pair, self.times))
        pairs, self.pair = np.unique(pair, return_inverse=True)
        self.a, self.b = np.divmod(pairs, size_b)
        self.holders = np.bincount(self.pair, minlength=len(pairs))
        self.n_held = np.bincount(document, minlength=n)
        self.counts[3] = np.bincount(document, self.times, n).astype(np.int64)
        self.digests = [x.hexdigest() if x and not out else "" for x, out in zip(digests, gone.tolist(), strict=True)]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
NUMBERS = ("a", "b", "holders")


def _batch_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per batch: its number, its documents, its distinct links and the packed matrix of documents and links."""
    kind = docs.schema[id_col].dataType.simpleString()
    lists = ", ".join([*(f"{c} array<bigint>" for c in COUNTS), "groups_sha256 array<string>", "n_held array<bigint>", *(f"{c} array<int>" for c in NUMBERS)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for rows in batches:
            at = 0
            for documents in _batches(x.as_py() for x in rows.column(1)):
                b, ids = Batch(aligner, documents), rows.column(0).slice(at, len(documents))
                at += len(documents)
                one = lambda values, of: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of) if not isinstance(values, pa.Array) else values)
                columns = [pa.array([number], pa.int64()), one(ids, None), *(one(c, pa.int64()) for c in b.counts), one(b.digests, pa.string()), one(b.n_held, pa.int64()),
                           *(one(x, pa.int32()) for x in (b.a, b.b, b.holders)), pa.array([_packed(b.pair)], pa.binary()), pa.array([_packed(b.times)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["batch", "ids", *COUNTS, "groups_sha256", "n_held", *NUMBERS, "pair", "times"])
                number += 1

    rows = spread(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(made, f"batch bigint, ids array<{kind}>, {lists}, pair binary, times binary")


def link_counts(batches: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold each link, and whether no link of the same ``a`` is held by more.

    Summed before the shuffle; an ``a`` has no more links than the other vocabulary has entries.
    """
    links = batches.select(F.inline(F.arrays_zip(*NUMBERS))).groupBy("a", "b").agg(F.sum(F.col("holders").cast("bigint")).alias("count"))
    return links.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _scored(kind: str, id_col: str, rows: DataFrame) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for k in range(len(some)):
                row = {n: some.column(n)[k] for n in some.schema.names}
                ids, held = row["ids"].values, np.asarray(row["n_held"].values)
                sums = np.zeros((2, len(ids)), np.int64)
                if n := int(held.sum()):
                    pair, times = (_unpacked(row[c].as_py(), n) for c in ("pair", "times"))
                    back = row["back"].values
                    count, best = (np.asarray(back.field(c)) for c in ("count", "best"))
                    full = np.flatnonzero(held)
                    starts = (np.cumsum(held) - held)[full]
                    for at, weight in enumerate((best, count)):
                        sums[at, full] = np.add.reduceat(times * weight[pair], starts)
                columns = [ids, *(row[c].values for c in COUNTS), pa.array(sums[0]), pa.array(sums[1]), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    schema = ", ".join([f"id {kind}", *(f"{c} bigint" for c in (*COUNTS, "n_best", "count_sum")), "groups_sha256 string"])
    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_col)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, counts of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256``.

    Both tokenizers encode a space and the text, the piece tokenizer by the space that it adds itself; strings of
    special tokens are plain text. ``n_best`` counts the links that as many documents hold as any link of their A id
    (ties included), ``count_sum`` sums over the links how many documents hold them, over all rows of ``docs``.
    ``groups_sha256`` is the digest of the groups (see ``Aligner.listings``). Null and empty texts, and texts whose
    tokens' bytes aren't the text's, have no tokens: zeros and ''. Rows repeat as they repeat in ``docs`` and each
    counts as a document, null ids too; an empty table gives no rows; other columns are ignored, whatever their
    names. Texts are whole: long ones are cut up at ends of words, where all groups end.
    """
    a_path, b_path = _paths(a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def made() -> DataFrame:
        batches = materialise(_batch_rows(docs, a_path, b_path, id_col, text_col))
        places = batches.select("batch", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select("batch", "at", "x.a", "x.b")
        told = places.join(link_counts(batches), ["a", "b"]).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("back"))
        kept = batches.select("batch", "ids", *COUNTS, "groups_sha256", "n_held", "pair", "times")
        return _scored(kind, id_col, kept.join(told, "batch", "left").drop("batch"))

    return settled(made)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, the ids ``a`` and ``b`` of both tokenizers, and ``groups``: where in a, b and the bytes each group ends.

    Ends are exclusive; the bytes are those of a space and the text. Odd rows as in ``align``: empty arrays.
    """
    a_path, b_path = _paths(a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        ends = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])
        for rows in batches:
            for k in range(len(rows)):
                text = rows.column(1)[k].as_py()
                t = aligner.tokens([segments(" " + text) if text else []])
                g = aligner.groups(t)
                upto = np.append(0, np.cumsum(aligner.lengths[0][t.a]))[g.first_a]
                group = [{"a": x, "b": y, "bytes": z} for x, y, z in zip(g.first_a[1:].tolist(), g.first_b[1:].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(k, 1), pa.array([t.a], pa.list_(pa.int32())), pa.array([t.b], pa.list_(pa.int32())), pa.array([group], pa.list_(ends))], ["id", "a", "b", "groups"])

    rows = spread(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(made, f"id {kind}, a array<int>, b array<int>, groups array<struct<a:bigint,b:bigint,bytes:bigint>>").withColumnRenamed("id", id_col)
