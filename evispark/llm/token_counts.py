"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary's trie has failure links and, beside each, the number of pieces that following it completes
(the linear longest-match construction published for word-piece tokenizers). One pass over a word's bytes
then gives the number of pieces; no piece is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

WORD_END = "</w>"
#: Words whose counts a worker remembers before it forgets them all.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(spare))
        spare += b not in printable
    return out


class Automaton:
    """Counts the greedy longest-match pieces of words.

    ``pieces``: sequences of symbols; a word is matched as its symbols followed by ``end``. A word with a
    part that no piece covers counts as one token (unknown).
    """

    def __init__(self, pieces, end=256) -> None:
        self.end = end
        self.next: list[dict] = [{}]
        token = [False]
        for p in pieces:
            u = 0
            for c in p:
                if c not in self.next[u]:
                    self.next[u][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                u = self.next[u][c]
            token[u] = u != 0
        # fail[v]: the node for what stays after the pieces that are certain at v are popped; -1 if none fits
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], n
            level = below

    def count(self, word) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for c in (*word, self.end):
            while c not in nxt[u]:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = nxt[u][c]
        while u:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


class Remembered(dict):
    """Counts of words seen so far, computed when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(word)
        return n


def load_pieces(vocabulary: str) -> list[list[int]]:
    """The pieces of a byte-level tokenizer file, as bytes, 256 for the end of a word."""
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = []
    for p in vocab:
        stem, ended = p.removesuffix(WORD_END), p.endswith(WORD_END)
        if all(c in byte_of for c in stem):
            out.append([byte_of[c] for c in stem] + [256] * ended)
    return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_words`` and ``n_tokens`` of its whole text, lower-cased.

    A word is a run without ASCII white space. ``vocabulary`` is a path that exists on every executor (by
    default that of the installed public tokenizers). Null and empty texts have no tokens; rows repeat as they
    repeat in ``docs``; an empty table gives no rows; other columns are ignored. There is no shuffle.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(Automaton(load_pieces(vocabulary)))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["t"]:
                words = text.lower().encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame({"id": batch["id"], "n_words": n_words, "n_tokens": n_tokens})

    rows = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(counted, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
