import random

from evispark.operators import selection


def test_rows_are_trimmed_as_a_plain_fold_does(spark):
    r = random.Random(15)
    rows = [(lang, s, i * 10 + j, r.choice([0, 1, 2, 5, 9, 40]), r.randrange(2)) for i, (lang, s) in enumerate([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]) for j in range(0, 10 if lang == "a" else 2)]
    got = selection.first_fit(spark.createDataFrame(rows, "lang string, source string, doc_id long, n long, k int"), ["lang"], ["source"], ["k", "doc_id"], "n", 100)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for lang in "ab":
        mine = sorted((x[1], x[4], x[2], x[3]) for x in rows if x[0] == lang)
        names, left = sorted({x[0] for x in mine}), 100
        fits = sum(x[3] for x in mine) <= 100
        for s in names:
            room = min(100 // len(names), left)
            for _, _, d, n in (x for x in mine if x[0] == s):
                if fits or n <= room:
                    want.append(d)
                    left, room = left - n, room - n
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(want)
