"""Periodic runs against a scan of every period; defined results of odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.llm import periodic_runs as pr


def brute(ws, least=24, periods=3):
    found = {}
    for q in range(1, len(ws) // periods + 1):
        i = 0
        while i < len(ws) - q:
            s = i
            while i < len(ws) - q and ws[i] == ws[i + q]:
                i += 1
            if i - s + q >= max(least, periods * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rnd):
    n = rnd.choice([0, 1, 23, 24, 25, 60, 200, 333])
    ws = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n else 0):
        a = rnd.randrange(n)
        p, e = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
        for i in range(a, e):
            ws[i] = ws[a + (i - a) % p]
    return ws


@pytest.mark.parametrize("cells", [pr.CELLS, 7])
def test_runs_of_random_words(monkeypatch, cells):
    monkeypatch.setattr(pr, "CELLS", cells)
    rnd = random.Random(11)
    for _ in range(60):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 6))]
        for ws, (n, runs, kept) in zip(texts, pr.runs_of([" ".join(t).encode() for t in texts]), strict=True):
            want = brute(ws)
            gone = {i for s, m, q in want for i in range(s + q, s + m)}
            assert (n, [tuple(r) for r in runs.tolist()]) == (len(ws), want)
            assert kept.decode() == " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_other_limits():
    ws = "x a b a b a b a b y y y y y".split()
    assert [tuple(r) for _, runs, _ in pr.runs_of([" ".join(ws).encode()], 4, 4) for r in runs.tolist()] == brute(ws, 4, 4) == [(1, 8, 2), (9, 5, 1)]
    with pytest.raises(ValueError):
        list(pr.runs_of([b"a a a a"], 2, 2))


def test_odd_rows(spark):
    long = "word " * 400_000 + "end"
    texts = [None, "", " \n\t", "a", "x " * 24, "x " * 24, "é\x0bé\x0c" * 12, long]
    rows = [(None if i == 3 else i, t, "id", "t", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, t string, runs string")
    got = {r["doc_id"]: r for r in pr.digest(pr.periodic_runs(docs)).collect()}
    assert len(got) == 8 and got[None]["n_runs"] == 0
    assert [got[i]["n_runs"] for i in (0, 1, 2)] == [0, 0, 0] and got[0]["start"] is None and got[0]["runs_sha256"] == got[2]["collapsed_sha256"]
    assert got[4][1:] == got[5][1:] and got[4][1:6] == (1, 0, 24, 1, 24000) == got[6][1:6]
    assert got[7][1:6] == (1, 0, 400_000, 1, 400_000_000)
    assert pr.periodic_runs(docs.where("false")).collect() == []


def test_strongest_is_exact_and_first_of_ties(spark):
    runs = [(0, 24, 8), (30, 30, 10), (70, 31, 10), (110, 62, 20)]
    row = spark.createDataFrame([(1, runs), (2, [])], f"doc_id long, runs array<{pr.RUN}>").select("doc_id", pr.strongest(F.col("runs")).alias("b"))
    assert {r["doc_id"]: r["b"] and tuple(r["b"]) for r in row.collect()} == {1: (70, 31, 10), 2: None}


def test_planted_tails(spark):
    import zlib

    texts = {i: " ".join(f"w{j}" for j in range(i % 90)) + " \n" for i in range(300)}
    got = {r["doc_id"]: r["text"] for r in pr.planted(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        ws, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and ws:
            g = h // 10
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if j < a else ws[a + (j - a) % p] for j, w in enumerate(ws)]
        assert got[i].split() == ws
