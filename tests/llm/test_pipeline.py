"""The pipeline on a small fixture against a plain model of its stages."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    clean = [prose(r.randrange(60, 150)) for _ in range(220)]
    near = clean[0].split()
    near[3] = "zzz"
    extra = [clean[5], clean[5].replace(" ", "  ", 3), "too short", None, "x y z " * 60]
    texts = clean + extra
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    columns = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert all(d.columns == columns for d in seen[:-1])
    ids = [sorted(x["doc_id"] for x in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == [*range(220), 220, 221]  # the last three fail the base rules
    assert ids[1] == list(range(220))
    assert ids[2] == ids[1] == ids[3] and sorted(set(ids[4])) == ids[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x["doc_id"] for x in whole.collect()) == ids[4]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
