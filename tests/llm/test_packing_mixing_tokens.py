"""Packing, mixing and token counts against brute force and round trips."""

import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from evispark.llm import mixing, packing, token_counts

SCHEMA = "doc_id long, text string, source string, rank long, length long"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else "s", 0, 0) for i, t in enumerate(texts)], SCHEMA)


def test_pieces_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(4)
    chars = ["a", "B", "'s", "9", "!", "é", "ß", "É", "ÿ", "×", "ª", "İ", "Σ", "😀", " ", "\n", "\t", "<|endoftext|>", "…", " ", "́"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(0, 60))) for _ in range(150)] + [None, "", "word " * 3000]
    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.pieces(docs_of(spark, texts), path).collect()
    tk = Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[j : j + 2048] for j in range(0, len(ids), 2048))]
    assert sorted((x["id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in made) == sorted(want)


def test_packed_sequences_are_gapless(spark):
    r = random.Random(5)
    texts = ["a " * r.choice([3, 5, 40, 700, 1500, 2047, 5000]) for _ in range(200)] + [None, "a"]
    found = packing.pack(docs_of(spark, texts)).collect()
    by: dict = {}
    for x in found:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(x["length"] for x in found)
    assert len(by) <= -(-total // 2048) * 1.2 + 1
    assert packing.pack(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_schedule(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 101): r.randrange(1, 40) for _ in range(30)}
    placed: dict = {}
    seen: Counter = Counter()
    for size, rank, n, first, offset in packing.best_fit(counts, 100):
        assert rank == seen[size]
        seen[size] += n
        for i in range(n):
            placed.setdefault(first + i, []).append((offset, size))
    assert seen == Counter(counts)
    gaps: list[int] = []  # plain best fit, largest first
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(100 - s)
    assert len(placed) == len(gaps)
    for s in placed.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 100


def test_period_is_fair():
    for weights in ({"a": 1}, {"a": 500, "b": 300, "c": 200}, {f"s{i}": i + 1 for i in range(30)}):
        whole, slots = sum(weights.values()), mixing.period(weights)
        assert sorted(t for s in slots.values() for t in s) == list(range(whole))
        for s, w in weights.items():
            assert len(slots[s]) == w
            for j, t in enumerate(slots[s]):  # less than one block from the target before and after each slot
                assert j * whole // w <= t < -(-(j + 1) * whole // w)
                assert abs(j - w * t / whole) < 1 and abs(j + 1 - w * (t + 1) / whole) < 1


def test_mix_places_every_document_once(spark):
    r = random.Random(6)
    sources = [r.choice(["a"] * 6 + ["b", "b", "c", None]) for _ in range(400)]
    weights = {"a": 5, "b": 3, "c": 2, "": 1}
    got = mixing.mix(docs_of(spark, ["t"] * 400, sources), weights, block=4).collect()
    assert len({x["row_no"] for x in got}) == len({x["position"] for x in got}) == 400
    slots: dict = {}
    for x in got:
        slots.setdefault(x["slot"], set()).add((x["source"], x["block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[s])) for s in range(len(slots))]
    for s in weights:
        assert [b for x, b in order if x == s] == list(range(-(-sources.count(s or None) // 4)))
    first_end = min(max(i for i, (x, _) in enumerate(order) if x == s) for s in weights)
    for n in range(1, first_end + 1):
        for s, w in weights.items():
            assert abs(sum(x == s for x, _ in order[:n]) - w * n / 11) < 1
    docs = docs_of(spark, [f"t{i}" for i in range(400)], sources)
    mixed = mixing.mixed(docs, weights, block=4)
    assert mixed.columns == docs.columns and mixed.count() == 400
    assert mixing.mix(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, ["x"] * 2001, [str(i) for i in range(2001)]))


def test_automaton_against_greedy():
    r = random.Random(8)
    for _ in range(200):
        pieces = {tuple(r.choice([0, 1, 256] if k else [0, 1]) for _ in range(r.randrange(1, 5))) for k in range(r.randrange(1, 12))}
        pieces = {p for p in pieces if 256 not in p[:-1]}
        auto = token_counts.Automaton(pieces)
        for _ in range(30):
            word = [r.randrange(2) for _ in range(r.randrange(0, 9))]
            s, i, n = (*word, 256), 0, 0
            while i < len(s):
                hit = max((k for k in range(1, len(s) - i + 1) if s[i : i + k] in pieces), default=0)
                if not hit:
                    n = 1
                    break
                i, n = i + hit, n + 1
            assert auto.count(word) == n, (pieces, word)


def test_token_counts(spark):
    texts = [None, "", "Hello  WORLD\n", "é" * 1000, "x" * 20_000]
    got = {x["doc_id"]: x for x in token_counts.token_counts(docs_of(spark, texts)).collect()}
    assert [got[i]["n_words"] for i in range(5)] == [0, 0, 2, 1, 1] and got[2]["n_tokens"] == 2 and got[0]["n_tokens"] == 0
    assert token_counts.token_counts(docs_of(spark, [])).count() == 0


def test_words_of_letters_skip_the_patterns(monkeypatch):
    import public_tokenizers

    made = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Words of LETTERS only", "words\tOF letters ONLY words", ""]
    want = [np.array(made.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "PLAIN", SimpleNamespace(fullmatch=lambda w: pytest.fail(w)))
    assert list(made.ids(texts)) == want
