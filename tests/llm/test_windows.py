"""Substring operators against brute force, with groups small and large, and odd rows."""

import random
from collections import Counter

import pytest

from evispark.llm import substring_dedup, suffix_dedup
from evispark.llm.windows import covered

SCHEMA = "doc_id long, text string, lang string, kept string, row_no long"


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé" for b in ("", "x", "yy")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = prose(60), prose(150)
    out: list[str | None] = [None, "", " \n\t", "short", prose(400), "ha " * 120, "ha " * 70 + "end"]
    out += [base] * 5 + [prose(20) + " " + passage + "\n" + prose(r.randrange(30)) for _ in range(25)]
    for _ in range(25):
        w = base.split()
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = r.choice(words) + "q"
        out.append("  ".join(w) if r.random() < 0.2 else " ".join(w))
    return out


def brute_bytes(texts: list[str], length: int) -> list[tuple[int, int]]:
    b = [t.encode() for t in texts]
    seen = Counter(x[i : i + length] for x in b for i in range(len(x) - length + 1))
    out = []
    for x in b:
        gone = set()
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append((bytes(c for i, c in enumerate(x) if i not in gone), sum(1 for i in gone if i - 1 not in gone)))
    return out


def brute_words(texts: list[str], length: int) -> list[str]:
    split = [t.encode().split() for t in texts]
    first: dict = {}
    for d, w in enumerate(split):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = []
    for d, w in enumerate(split):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize(("seed", "large"), [(1, 256), (2, 4)])
def test_suffix_dedup(spark, seed, large):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", "clash", 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, length=60, gram=12, chunk=3000, large=large).collect()}
    for i, (kept, spans) in enumerate(brute_bytes([t or "" for t in texts], 60)):
        assert (bytes(got[i]["kept"]), len(got[i]["spans"])) == (kept, spans), i
        assert got[i]["n_bytes"] == len((texts[i] or "").encode()) and got[i]["n_removed"] == got[i]["n_bytes"] - len(kept)


@pytest.mark.parametrize(("seed", "large"), [(3, 256), (4, 4)])
def test_substring_dedup(spark, seed, large):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", "clash", 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, length=15, gram=4, chunk=3000, large=large).collect()}
    for i, kept in enumerate(brute_words([t or "" for t in texts], 15)):
        assert got[i]["kept"] == kept, i
        assert got[i]["n_words"] == len((texts[i] or "").split())


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()) == [(-1, 120), (3, 0), (3, 0)]
    assert all(r["n_removed"] == r["n_bytes"] for r in suffix_dedup.suffix_dedup(docs).collect())


def test_covered():
    assert covered([30, 0, 12], [31, 2, 12], 10) == [(0, 22), (30, 41)]
