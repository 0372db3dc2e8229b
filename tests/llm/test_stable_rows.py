"""Rows keep their numbers when scans are cut up differently, whatever columns the table has."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter
from test_windows import brute_bytes, brute_words

from evispark.llm import common, exact_dedup, mixing, near_dedup, quality, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, row_no long, id string, __row_no long, __file string, __index int, __at int, __part int, __position int, h int, t string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n))
    texts = [prose(r.randrange(55, 90)) for _ in range(40)]
    texts += r.choices(texts, k=30) + ["short", None, ""]
    r.shuffle(texts)
    return [(None if i == 5 else i, t, "en", r.choice("ab"), 1, "x", i, "f", 2, 3, 4, 5, 6, "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("rows") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(where)
    return where


@pytest.fixture
def docs(spark, path, monkeypatch):
    """The table; the default parallelism, by which scans are cut up, changes after each table that is written."""
    kept, at = DataFrameWriter.parquet, [0]

    def parquet(self, *args, **kwargs):
        kept(self, *args, **kwargs)
        at[0] += 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str((2, 8, 3)[at[0] % 3]))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    yield spark.read.parquet(path)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def first_of_each(rows):
    best: dict = {}
    for r in rows:
        key = " ".join((r[1] or "").split())
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return sorted(map(repr, best.values()))


def test_numbers_do_not_depend_on_the_cut(spark, docs):
    found = {}
    for n in (1, 2, 5, 8):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
        for r in common.numbered(docs, F.col("__row_no").alias("own")).collect():
            assert found.setdefault(r["own"], r["row_no"]) == r["row_no"]
    assert len(set(found.values())) == 73


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_one, near_dedup.keep_one])
def test_one_of_each_text_stays(docs, rows, keep):
    got = keep(docs)
    assert got.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == first_of_each(rows)


def test_what_is_not_a_scan_is_written_first(docs, rows):
    shuffled = docs.withColumn("__row_no", F.col("__row_no") + (F.rand() * 0).cast("long")).orderBy(F.rand())
    assert sorted(repr(tuple(r)) for r in exact_dedup.keep_first(shuffled).collect()) == first_of_each(rows)


def test_good_rows_stay(docs, rows):
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(r) for r in rows if len((r[1] or "").split()) >= 50)


def test_mixed_rows_all_stay(docs, rows):
    got = mixing.mixed(docs, {"a": 2, "b": 1}, block=4)
    assert got.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, rows))


def test_substring_operators(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [r[1] or "" for r in ordered]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, length=60, gram=12, chunk=3000).collect()}
    for r, (kept, spans) in zip(ordered, brute_bytes(texts, 60), strict=True):
        assert (bytes(got[r[0]]["kept"]), len(got[r[0]]["spans"])) == (kept, spans)
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(docs, length=15, gram=4, chunk=3000).collect()}
    assert [got[r[0]] for r in ordered] == brute_words(texts, 15)
