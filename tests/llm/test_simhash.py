"""Fingerprints and components against brute force; crowded blocks by both ways."""

import random
import re

import numpy as np
import pytest
import xxhash

from evispark.llm import simhash
from evispark.llm.graph import connected_components

SCHEMA = "doc_id long, text string, first string, fp long"


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_roots(keys, near):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("large", [4000, 1])
def test_components(spark, large):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    base = [r.choice(words) for _ in range(300)]
    texts = ["", None, " \n", "One two", "ONE TWO", "a b c d e", "ÀB c d e"]
    texts += [" ".join(r.choice(words) for _ in range(30)) for _ in range(20)]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "z"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {x["doc_id"]: x for x in simhash.simhash_components(docs, large=large).collect()}
    fp = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    want = brute_roots(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {i: (x["fingerprint"], x["component_id"]) for i, x in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert {i for i, x in got.items() if x["first"]} == set(want.values())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == set(want.values())


@pytest.mark.parametrize("large", [4000, 3])
def test_links_of_random_fingerprints(spark, large):
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            for _ in range(r.randrange(1, 6)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.link_edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), len(fps), large=large)
    got = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    want = brute_roots([signed(f) for f in fps], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert all(got.get(k, k) == v for k, v in want.items())  # edges may join what is linked by a chain only


def test_masks_meet_all_close_pairs():
    r = random.Random(2)
    for blocks in (5, 6, 8):
        m = simhash.masks(blocks)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & k == 0 for k in m)
    assert simhash.blocks_for(100) == 5 and simhash.blocks_for(10**9) > 5


def test_empty_null_ids_and_repeats(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "x y", "", 0), (4, "x y", "", 0), (4, "x y", "", 0)], SCHEMA).coalesce(1)
    got = simhash.simhash_components(docs).orderBy("row_no").collect()
    assert [(x["component_id"], x["first"]) for x in got] == [(4, False), (4, True), (4, False)]
    assert simhash.fingerprint("w " * 50_000) == simhash.fingerprint("W " * 50_000)


def test_chain_of_components(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {x["root"] for x in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a < 0")).count() == 0
    assert np.bitwise_count(np.uint64(7)) == 3
