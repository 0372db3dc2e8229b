"""Held-out accuracy, calibration, and odd rows."""

import random

import numpy as np

from evispark.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    prose = lambda k: ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(k)]
    texts, labels = [], []
    for _ in range(n):
        w, bad = prose(r.randrange(20, 120)), r.random() < 0.25
        for _ in range(r.randrange(1, 4) * bad):
            w.insert(r.randrange(len(w)), r.choice(["Scumbag,", "nitwit", "you", "NITWIT!"]))
        if bad and not any("nitwit" in x.lower() or "scumbag" in x.lower() for x in w):
            w.append("nitwit")
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, y = corpus()
    docs = spark.createDataFrame([(i, t, "x", 9.0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y) if i % 3] + [(None, 1), (10_000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {b"nitwit", b"scumbag"} <= set(model.lexicon)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = range(0, len(y), 3)
    right = sum(got[i]["predicted"] == y[i] for i in held) / len(held)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(None, None, "x", 1.0), (1, "", "x", 1.0), (2, "n.i.t.w.i.t " * 20_000, "x", 1.0)], SCHEMA)
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 3 and scores[0] == scores[1] < 0.5
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0


def test_without_labels_or_one_class(spark):
    docs = spark.createDataFrame([(i, "t", "x", 1.0) for i in range(30)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["score"] == 0.5
    same = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, same)).first()["score"] == 0.0


def test_isotonic_against_definition():
    r = np.random.default_rng(3)
    s, y = r.integers(0, 20, 200).astype(float), r.integers(0, 2, 200).astype(float)
    at, v = toxicity.isotonic(s, y)
    assert (np.diff(v) >= 0).all()
    n = np.array([(s == a).sum() for a in at])
    m = np.array([y[s == a].mean() for a in at])
    for k in range(len(at)):  # max over starts of min over ends of block means
        want = max(min((m[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1))
        assert abs(v[k] - want) < 1e-9


def test_boosting_fits_an_interaction():
    r = np.random.default_rng(4)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    f = toxicity.Boosted().fit(x[:1000], y[:1000]).margin(x[1000:])
    assert ((f > 0) == (y[1000:] > 0)).mean() > 0.95


def test_words_are_listed_some_texts_at_a_time():
    """Before, a task held the words of its 10,000 texts at once."""
    import tracemalloc

    import pandas as pd

    texts, labels = corpus(600)
    rows = pd.DataFrame({"t": [f"{t} {' '.join(f'w{chr(97 + i % 26)}' + chr(97 + k % 26) * (1 + k // 26) for k in range(200))}" for i, t in enumerate(texts)], "y": labels}).sample(4000, replace=True, random_state=1)
    words = lambda frames: {x for f in frames for x in f.itertuples(index=False, name=None)}
    few = rows.iloc[:500]
    assert words(toxicity.signed([few])) == words(toxicity.signed(few.iloc[i : i + 1] for i in range(len(few))))
    tracemalloc.start()
    n = sum(len(f) for f in toxicity.signed([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 400_000 and peak < 60_000_000
