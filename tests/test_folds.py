"""Ordered folds against plain loops; their time grows with the parts, not with the square."""

import random
import time

from pyspark.sql import functions as F

from evispark.operators import merging


def plain_text(parts, separator="\n\n"):
    acc = ""
    for x in parts:
        if x and x != acc:
            acc = acc + separator + x if acc else x
    return acc


def plain_strings(parts):
    acc = []
    for x in parts:
        if acc:
            for v in x or []:
                if v not in acc:
                    acc.append(v)
        else:
            acc = list(x or [])
    return acc


def plain_objects(parts):
    acc = []
    for x in parts:
        acc = acc + [v for v in x or [] if v not in acc]
    return acc


def test_folds_are_plain_loops(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(250):
        n = rnd.randrange(9)
        texts = [rnd.choice([None, "", "a", "b", "a\n\nb", "a\n\nb\n\na", "é"]) for _ in range(n)]
        strings = [rnd.choice([None, [], ["x"], ["x", "x", "y"], ["z", None, "y", "z"]]) for _ in range(n)]
        objects = [rnd.choice([None, [], [("a", 1)], [("b", 2), ("a", 1), ("b", 2)], [(None, 3), (None, 3)]]) for _ in range(n)]
        rows.append((i, texts, strings, objects))
    df = spark.createDataFrame(rows, "i int, t array<string>, s array<array<string>>, o array<array<struct<a:string,b:int>>>")
    kinds = merging.fold_text(F.col("t")), merging.fold_strings(F.col("s")), merging.fold_objects(F.col("o"), "struct<a:string,b:int>")
    got = {r["i"]: r for r in df.select("i", *(k.alias(n) for k, n in zip(kinds, "tso", strict=True))).collect()}
    for i, texts, strings, objects in rows:
        r = got[i]
        assert (r["t"], r["s"], [tuple(x) for x in r["o"]]) == (plain_text(texts), plain_strings(strings), plain_objects(objects))


def test_a_hot_item_takes_time_by_its_parts(spark):
    def took(n, items):
        parts = spark.range(n).selectExpr(f"concat('i', id % {items}) AS id", "cast(id AS int) AS batch", "0 AS pos", "concat('turn ', id) AS text", "array(concat('t', id % 5000), concat('u', id)) AS tags",
                                          "named_struct('quality', 'low', 'rationale', concat('r', id), 'citations', array(named_struct('source_id', concat('s', id % 100), 'locator', 'l', 'source_title', 't'))) AS evidence")
        start = time.time()
        merging.merge_items(parts, "id", ("text",), ("tags",), "evidence").write.format("noop").mode("overwrite").save()
        return time.time() - start

    took(1000, 10)
    assert took(40_000, 1) < 6 * took(40_000, 1000) + 5


def test_nothing_is_gathered_where_nothing_is_folded(spark):
    parts = spark.createDataFrame([("a", 1, 0, "later"), ("a", 0, 5, "first"), ("b", 0, 2, None), ("", 0, 0, "x")], "id string, batch int, pos int, label string")
    merged = merging.merge_items(parts, "id")
    assert "collect_list" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], tuple(r["item_order"]), r["label"]) for r in merged.collect()) == [("a", (0, 5), "first"), ("b", (0, 2), None)]
