"""The order of the mixture in the pipeline's sequences."""

import random

import pytest

import corpus_pipeline
from evispark.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_sequences_of_the_run_hold_the_target_shares(spark, tmp_path, monkeypatch):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(i, prose(r.randrange(60, 150)), "en", "a" if i < 2400 else "b" if i < 2700 else "c", 0) for i in range(3000)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(packing, "WINDOW", 64)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    source = {x[0]: x[3] for x in rows}
    kept = {x["doc_id"] for x in got}
    counts = {s: sum(source[i] == s for i in kept) for s in "abc"}
    weights = mixing.tempered_weights(counts)
    first = {}
    for x in got:
        first[x["doc_id"]] = min(first.get(x["doc_id"], 1 << 60), x["sequence_id"])
    order = sorted(first, key=first.get)
    lasts = min(counts[s] / weights[s] for s in "abc") * sum(weights.values())  # documents until a source is used up
    assert lasts > 1000
    for n in range(64, int(lasts), 64):
        for s in "abc":
            assert abs(sum(source[i] == s for i in order[:n]) - n * weights[s] / sum(weights.values())) <= 2 * mixing.BLOCK


@pytest.mark.parametrize("window", [7, 1000])
def test_windows_follow_one_another_without_gaps(spark, window):
    r = random.Random(13)
    texts = ["a " * r.choice([3, 5, 40, 700, 1500, 2047, 5000]) for _ in range(100)] + [None, "a"]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, order, strict=True))], "doc_id long, text string, place long")
    got = packing.pack_in_order(docs, "place", window=window).collect()
    want = packing.pack(docs).collect()
    piece = lambda x: (x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])
    assert sorted(map(piece, got)) == sorted(map(piece, want))
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"], order[x["doc_id"]]))
    assert sorted(by) == list(range(len(by)))
    for s in by.values():
        at = 0
        for offset, n, _ in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and len({p // window for *_, p in s}) == 1
    firsts = [min(p for *_, p in by[s]) for s in sorted(by)]
    assert firsts == sorted(firsts)
    assert packing.pack_in_order(docs.where("doc_id < 0"), "place").count() == 0


def test_written_order(spark, tmp_path):
    spark.range(5000).repartition(7).orderBy("id").write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "t"))
    back = packing.written_order(spark.read.parquet(str(tmp_path / "t")))
    assert all(x["id"] == x["__position"] for x in back.collect())


def test_stages_with_clashing_columns(spark, tmp_path):
    clash = "doc_id long, text string, lang string, source string, n_chars long, __file string, __index int, __base int, __position long, _metadata string, row_no long, id string"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60 + i)), "en", f"s{i % 3}", 9, "f", 1, 2, 77, "m", 5, "i") for i in range(30)]
    spark.createDataFrame(rows, clash).repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    back = packing.written_order(docs)
    assert back.columns == [c for c in docs.columns if c != "__position"] + ["__position"]
    assert sorted(r["__position"] for r in back.collect()) == list(range(30))
    for f in (lambda d: packing.pack_in_order(packing.written_order(d), "__position"), packing.pack, mixing.mixed):
        assert {r["doc_id"] for r in f(docs).collect()} == set(range(30))
