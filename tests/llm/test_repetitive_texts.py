"""Texts that repeat themselves: the same results as brute force, and few contexts however long they are."""

import random

import numpy as np
import pytest
from tests.llm.test_windows import brute_bytes, brute_words

from evispark.llm import substring_dedup, suffix_dedup
from evispark.llm.windows import Bytes, Words, anchors, copied, uncopied, with_copies


def repetitive(seed: int) -> list[str]:
    """Stretches of different periods, some with an error in them, some in several texts."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))
    units = ["z ", "ab c ", prose(5) + " ", prose(17) + " ", "q q w "]
    out = []
    for _ in range(40):
        t = r.choice(["", prose(9)])
        for _ in range(r.randrange(3)):
            w = (r.choice(units) * r.randrange(1, 60))[r.randrange(5) :]
            if w and r.random() < 0.4:
                i = r.randrange(len(w))
                w = w[:i] + "!" + w[i + 1 :]
            t += w + r.choice(["", prose(6)])
        out.append(t)
    return [*out, "z " * 30, "z " * 300]


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts_as_brute_force(spark, seed):
    texts = repetitive(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, length=60, gram=12, chunk=3000).collect()}
    for i, (kept, spans) in enumerate(brute_bytes(texts, 60)):
        assert (bytes(got[i]["kept"]), len(got[i]["spans"])) == (kept, spans), i
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(docs, length=15, gram=4, chunk=3000).collect()}
    for i, kept in enumerate(brute_words(texts, 15)):
        assert got[i] == kept, i


def listed(units, u, length, gram):
    hashes = units.hashes(u)
    for some in anchors(hashes, length, gram):
        copies = copied(hashes, lambda x, y, m: units.same(u, x, y, m), some, length)
        yield some, copies, uncopied(some, copies)


@pytest.mark.parametrize("seed", range(20))
def test_copies_equal_what_they_repeat_and_nothing_is_lost(seed):
    r = random.Random(seed)
    u = b"".join(bytes(r.choice(b"abc") for _ in range(r.randrange(1, 30))) * r.randrange(1, 40) for _ in range(6))
    for some, copies, rest in listed(Bytes(), u, 40, 8):
        windows = lambda x: {w for f, e in zip(x[2].tolist(), x[3].tolist(), strict=True) for w in range(f, e + 1)}
        gone = {w for f, e, _ in copies for w in range(f, e + 1)}
        assert windows(rest) == windows(some) - gone and gone <= windows(some)
        for f, e, p in copies:
            assert all(u[w : w + 40] == u[w - p : w - p + 40] for w in range(f, e + 1))
            assert not gone & set(range(f - p, f))


def test_a_long_run_is_one_context():
    for units, u, length, gram in ((Bytes(), b"=" * 5_000_000, 400, 64), (Bytes(), b"abc" * 300_000, 400, 64), (Words(), [b"w"] * 200_000, 50, 12)):
        for _, copies, rest in listed(units, u, length, gram):
            assert len(copies) == 1 and len(rest[0]) <= 2 and int((rest[3] - rest[2] + 1).sum()) <= 3


def test_copies_of_runs():
    stretch = [{"first": 13, "last": 30, "period": 3}]  # windows 10 to 12 again and again
    spread = lambda f, e: sorted({w for x, y in zip(*with_copies(f, e, stretch, False), strict=True) for w in range(x, y + 1)})
    assert spread(None, None) == [] and spread([10], [12]) == list(range(10, 31))
    assert spread([11], [11]) == list(range(11, 31, 3)) and spread([0, 12], [10, 20]) == sorted({*range(11), *range(12, 21), *range(10, 31, 3), *range(12, 31, 3)})
    assert with_copies(np.array([50]), np.array([60]), stretch, True) == ([50, 10], [60, 30])


def test_very_long_runs_in_bounded_memory(spark):
    import resource

    texts = ["=" * 4_000_000, "abc" * 1_000_000, "=" * 1000, "w " * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).orderBy("doc_id").collect()] == [len(t) for t in texts]
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0]

    def peak(batches):
        import pandas as pd

        for _ in batches:
            pass
        yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1000]})

    assert max(r["mb"] for r in spark.range(8).repartition(8).mapInPandas(peak, "mb double").collect()) < 1000
