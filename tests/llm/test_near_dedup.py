"""The near stage against brute force over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from evispark.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_stage_against_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = ["", None, " \n", "One two", "ONE two"]
    for _ in range(40):
        base = [word() for _ in range(r.randrange(100, 400))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(0, 4)):
            w = list(base)
            for _ in range(r.choice([1, len(w) // 50, len(w) // 20])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(200)]  # a template: some of these are alike, others are not
    for _ in range(30):
        at = r.randrange(0, 160)
        texts.append(" ".join(base[:at] + [word() for _ in range(r.choice([2, 25]))] + base[at:]))
    shingled = [sets(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(shingled[i], shingled[j]) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(root))


def test_parity_maps_never_overstate_a_difference():
    r = np.random.default_rng(5)
    for n in (0, 1, 20, 200, 5000):
        for changed in (0, 1, n // 10, n // 2, n):
            a = r.integers(0, 1 << 64, n, dtype=np.uint64)
            b = np.r_[a[changed:], r.integers(0, 1 << 64, changed, dtype=np.uint64)]
            bits = int(np.bitwise_count((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b))
            assert changed or not bits
            assert n > 200 or bits >= 0.7 * len(np.setxor1d(a, b))


def test_a_crowd_of_unlike_copies(spark):
    """Copies of one text, each changed in places of its own: hardly any two have the similarity, some chains do."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(120)], []
    for i in range(150):
        w = list(base) if i % 3 else texts[r.randrange(len(texts))].split() if texts else list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    shingled = [sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(shingled[i], shingled[j]) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    assert 1 < len(set(root)) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in near_dedup.keep_one(docs).collect()) == sorted(set(root))


def test_near_copy_goes_in_the_stage(spark):
    r = random.Random(2)
    clean = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(100))
    near = clean.split()
    near[3] = near[60] = "zzz"
    docs = spark.createDataFrame([(1, clean, "en", "s", 0), (2, " ".join(near), "en", "s", 0)], SCHEMA)
    assert 0.8 < jaccard(sets(clean), sets(" ".join(near))) < 0.9
    assert [x["doc_id"] for x in corpus_pipeline.near_stage(spark, docs, "").collect()] == [1]
    assert near_dedup.keep_one(docs.where("doc_id < 0")).count() == 0


def test_pairs_come_from_fingerprints_in_blocks(spark):
    """Fingerprints differ by the angle of the sets; what blocks propose is what the Hamming distance says."""
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64)
    off = []
    for n in (18, 90, 900):
        for _ in range(60):
            common, own, other = fresh(n * 8 // 9), fresh(n // 9), fresh(n // 9)
            a, b = (near_dedup.fingerprint(np.r_[common, x]) for x in (own, other))
            off.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(off) / near_dedup.BITS - near_dedup.apart(0.8)) < 0.01 and max(off) <= near_dedup.farthest(0.8)
    fp = np.array([near_dedup.fingerprint(fresh(100))[: near_dedup.SENT] for _ in range(150)])
    for i in range(1, 150, 3):  # near the one before, some of them
        fp[i] = fp[i - 1]
        fp[i].view(np.uint8)[: r.integers(0, 32)] ^= r.integers(0, 256, dtype=np.uint8)
    distance = lambda x: np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=int)
    first = np.bitwise_count(fp[:, None, : near_dedup.PREFIX] ^ fp[None, :, : near_dedup.PREFIX]).sum(axis=2, dtype=int)
    near = (distance(fp) <= near_dedup.farthest(bits=64 * near_dedup.SENT)) & (first <= near_dedup.farthest(bits=64 * near_dedup.PREFIX)) & ~np.eye(150, dtype=bool)
    found = near_dedup.leaders(fp, np.full(150, 100))
    assert near.any() and all(near[i, j] for i, j in found)
    assert {x for pair in found for x in pair} == set(np.flatnonzero(near.any(axis=1)).tolist())


def test_recall_at_the_similarity(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    while len(texts) < 600:
        base = [word() for _ in range(r.randrange(60, 300))]
        w = list(base)
        while jaccard(sets(" ".join(base)), sets(" ".join(w))) > 0.83:
            w[r.randrange(len(w))] = word()
        if jaccard(sets(" ".join(base)), sets(" ".join(w))) >= 0.8:
            texts += [" ".join(base), " ".join(w)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in near_dedup.keep_one(docs).collect()) == list(range(0, 600, 2))


def crowd(n, seed, words, changes):
    """Copies of a text, each changed in places of its own, so that far more pairs are near than leaders link."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(words)], []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice(changes)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


def components(texts):
    shingled, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(shingled[i], shingled[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


def test_no_table_grows_with_the_square_of_a_group(spark, monkeypatch):
    texts, written = crowd(400, 8, 400, (4, 5)), []
    root = components(texts)

    def materialise(df, f=near_dedup.materialise):
        written.append((out := f(df)).count())
        return out

    monkeypatch.setattr(near_dedup, "materialise", materialise)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in near_dedup.keep_one(docs).collect()) == sorted(set(root))
    assert max(written) < 10 * len(texts)


def test_tiles_of_a_block_have_all_its_pairs(spark):
    texts = crowd(200, 9, 120, (1, 2, 3))
    found = [near_dedup.shingles(t) for t in texts]
    rows = [(i, len(h), bytearray(near_dedup.fingerprint(h).tobytes()), i, bytearray(near_dedup.parity(h).tobytes()), h.view(np.int64).tolist()) for i, h in enumerate(found)]
    rows = spark.createDataFrame(rows, "key long, n long, fp binary, root long, odd binary, s array<long>")
    met = near_dedup.materialise(near_dedup._met(rows.drop("s"), near_dedup.drawn_bits(len(texts)), near_dedup.SIMILARITY))
    want = components(texts)
    assert 1 < len(set(want)) < len(texts)
    for tile_rows, tile_shingles in ((near_dedup.TILE_ROWS, near_dedup.TILE_SHINGLES), (20, near_dedup.TILE_SHINGLES), (1000, 2000)):
        tiled = near_dedup._tiled(met, tile_rows, tile_shingles)
        assert (tiled.count() > met.count()) == (tile_rows < 1000 or tile_shingles == 2000)
        root = list(range(len(texts)))
        for a, b in near_dedup._joined(met, rows, near_dedup.SIMILARITY, tile_rows, tile_shingles).collect():
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
        assert root == want
