"""Groups, links and counts of two tokenizers against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from evispark.llm import alignment as al

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def groups(tokenizers, text):
    """Pairs of id lists; none where the tokens' bytes aren't those of a space and the text."""
    if not text:
        return []
    a, b = tokenizers
    byte_of = {c: i for i, c in enumerate(al.byte_alphabet())}
    tokens_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tokens_b = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if any(b"".join(x for _, x in t) != f" {text}".encode() for t in (tokens_a, tokens_b)):
        return []
    out, x, y = [], 0, 0
    while tokens_a:
        ga, gb = [tokens_a.pop(0)], [tokens_b.pop(0)]
        x, y = len(ga[0][1]), len(gb[0][1])
        while x != y:
            if x < y:
                ga.append(tokens_a.pop(0))
                x += len(ga[-1][1])
            else:
                gb.append(tokens_b.pop(0))
                y += len(gb[-1][1])
        out.append(([i for i, _ in ga], [i for i, _ in gb]))
    return out


def texts():
    rnd = random.Random(12)
    odd = ["".join(rnd.choice(" \n\t ab'sé1.,▁　\xa0\r\x1f\x85😀語\0") for _ in range(rnd.randint(0, 24))) for _ in range(400)]
    words = [" ".join(rnd.choice(["the", "Unter", "éon", "x=1;", "don't", "😀😀", "1234567", "re-entry,"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    return [*odd, *words, *words[:9], None, "", "<|endoftext|> <s> </s> <unk>", "=" * 900, "ab" * 800, " " * 700, "\n" * 300, "1234567890" * 60, "😀" * 90, "語" * 200]


@pytest.mark.parametrize(("batch", "wide"), [(al.BATCH, al.WIDE), (300, 3)])
def test_counts_links_and_digests(spark, tokenizers, monkeypatch, batch, wide):
    monkeypatch.setattr(al, "BATCH", batch)
    monkeypatch.setattr(al, "WIDE", wide)
    own = texts()
    want = [groups(tokenizers, t) for t in own]
    links = [Counter((x, y) for g in w for x in g[0] for y in g[1]) for w in want]
    aligner, got = al.Aligner(*PATHS), []
    for documents in al._batches(own):
        b = al.Batch(aligner, documents)
        got += [(*c, d) for *c, d in zip(*b.counts.tolist(), b.digests, strict=True)]
        held = Counter(p for found in links[len(got) - len(documents) : len(got)] for p in found)
        assert dict(zip(zip(b.a.tolist(), b.b.tolist(), strict=True), b.holders.tolist(), strict=True)) == held
        assert sum(b.times) == sum(b.counts[3]) and sum(b.n_held) == len(b.times)
    for t, w, found, row in zip(own, want, links, got, strict=True):
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in w)
        assert row == (sum(len(x) for x, _ in w), sum(len(y) for _, y in w), len(w), found.total(), hashlib.sha256(listed.encode()).hexdigest() if w else ""), t


def test_counts_over_the_corpus(spark, tokenizers):
    own = texts()
    rows = [(None if i == 7 else i % 450, t, "i", "t", 1) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, t string, batch int").repartition(3)
    links = [Counter((x, y) for g in groups(tokenizers, t) for x in g[0] for y in g[1]) for t in own]
    held = Counter(p for found in links for p in found)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    want = sorted((-1 if r[0] is None else r[0], found.total(), sum(n for p, n in found.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in found.items())) for r, found in zip(rows, links, strict=True))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in al.align(docs).collect())
    assert got == want
    assert al.align(docs.where("false")).collect() == []


def test_alignments_end_where_both_do(spark, tokenizers):
    own = ["Unter der re-entry,\n 1234567 😀", "", None]
    rows = {r["doc_id"]: r for r in al.alignments(spark.createDataFrame(list(enumerate(own)), "doc_id int, text string")).collect()}
    x = y = 0
    for g, (a, b) in zip(rows[0]["groups"], groups(tokenizers, own[0]), strict=True):
        assert (rows[0]["a"][x : g["a"]], rows[0]["b"][y : g["b"]]) == (a, b)
        x, y = g["a"], g["b"]
    assert rows[0]["groups"][-1]["bytes"] == len(own[0].encode()) + 1 and rows[1]["groups"] == rows[2]["a"] == []


def test_ids_by_rank_are_the_tokenizers(tokenizers):
    rnd = random.Random(5)
    some = ["".join(chr(rnd.choice([rnd.randrange(128), rnd.randrange(0x600), rnd.randrange(0xD800)])) for _ in range(20)) for _ in range(3000)]
    assert al.ByteTokens(PATHS[0]).encode(some) == [e.ids for e in tokenizers[0].encode_batch(some, add_special_tokens=False)]


def test_packed_numbers_come_back():
    import numpy as np

    for x in ([], [0], [5, 3, 2**32 - 1, 0, 7]):
        assert al._unpacked(al._packed(np.array(x, np.int64)), len(x)).tolist() == x


def test_a_batch_is_worked_on_in_steps(monkeypatch):
    """What a worker holds at once doesn't grow with the batch; before, a batch of 4,000,000 characters was one step."""
    rnd = random.Random(3)
    own = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)) for _ in range(500)]
    own.append(" ".join(own[:300]))  # a long one
    steps, tokens = [], al.Aligner.tokens

    def seen(self, documents):
        steps.append(sum(len(s) for parts in documents for s in parts))
        out = tokens(self, documents)
        assert len(self.known[0]) < al.REMEMBERED + steps[-1]
        return out

    monkeypatch.setattr(al.Aligner, "tokens", seen)
    aligner = al.Aligner(*PATHS)
    (batch,) = [al.Batch(aligner, documents) for documents in al._batches(own)]
    assert sum(steps) == sum(len(t) + 1 for t in own) > 2_000_000 and max(steps) < 1_000_000
    assert batch.counts[3, -1] > 0.99 * batch.counts[3, :300].sum()


def test_a_long_document_is_left_out_as_a_whole(tokenizers, monkeypatch):
    monkeypatch.setattr(al, "BATCH", 300)
    own = ["plain words " * 60, "plain words " * 60 + "▁ more", "plain words"]
    assert [bool(groups(tokenizers, t)) for t in own] == [True, False, True]
    aligner, got = al.Aligner(*PATHS), []
    for documents in al._batches(own):
        b = al.Batch(aligner, documents)
        got += zip(b.counts.sum(axis=0).tolist(), b.n_held.tolist(), b.digests, strict=True)
        assert sum(b.times) == sum(b.counts[3]) and sum(b.n_held) == len(b.times)
    assert got[0][0] > 0 and got[1] == (0, 0, "") and got[2][0] > 0
