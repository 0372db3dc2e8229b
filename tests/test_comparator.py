import math
import statistics

import pytest

from evispark.operators import comparator as c

SCHEMA = "Country string, `GDP ` string, MMR string, U5M string, CPR string, PHC string, Region string"


def table(spark):
    rows = [(f"L{i}", str(i * 3 % 7), str(i % 5), str(i), str(10 - i), str(i % 3), " R " if i % 2 else "Q") for i in range(1, 12)]
    rows += [("Target", "4", "3", "6", "2", "1", "R"), ("Bare", "x", "NaN", "", "1", "1", "R")]
    return spark.createDataFrame(rows, SCHEMA)


def test_end_to_end_against_model(spark):
    df = table(spark)
    similar, aspirational = c.comparator_index(df, " target ", 20, 2, ("Region", "Absent"), "MMR=2,zzz=5")
    cols = ["GDP", "MMR", "U5M", "CPR", "PHC"]
    data = {r[0]: [float(x) for x in r[1:6]] for r in df.collect() if r[0] != "Bare" and r[6].strip() == "R"}
    z = {}
    for j in range(5):
        vals = [v[j] for v in data.values()]
        s = statistics.pstdev(vals)
        z[j] = {k: (v[j] - statistics.mean(vals)) / s if s else 0.0 for k, v in data.items()}
    w = [1, 2, 1, 1, 1]
    dist = {k: math.sqrt(sum(w[j] * (z[j][k] - z[j]["Target"]) ** 2 for j in range(5))) for k in data if k != "Target"}
    got = similar.collect()
    assert [r["Country"] for r in got] == sorted(dist, key=lambda k: (dist[k], k))
    assert all(r["distance"] == pytest.approx(dist[r["Country"]]) for r in got) and "z_GDP" in got[0].asDict()
    t = data["Target"]
    better = {k: (v[1] < t[1]) + (v[2] < t[2]) + (v[3] > t[3]) + (v[4] > t[4]) for k, v in data.items()}
    pool = sorted(dist, key=lambda k: (dist[k], k))[: max(int(0.5 * len(dist)), 6)]
    want = sorted((k for k in pool if better[k] >= 3), key=lambda k: (-better[k], dist[k], k))[:2]
    assert [r["Country"] for r in aspirational.collect()] == want
    assert cols


def test_flat_columns_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), ("c", 1.0, 4.0)], "Country string, x double, y double")
    z = {r["Country"]: r for r in c.zscores(df, ["x", "y"]).collect()}
    assert z["a"]["z_x"] == 0.0 and z["a"]["z_y"] is None and z["b"]["z_y"] == -1.0
    assert [r["_missing_n"] for r in c.drop_sparse(df, ["x", "y"]).orderBy("Country").collect()] == [1, 0, 0]


def test_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("A ", 2.0)], "Country string, x double")
    for target in ("a", "nowhere"):
        with pytest.raises(ValueError):
            c.target_row(df, target)
    with pytest.raises(ValueError):
        c.numeric_columns(df, ["y"])
    assert c.parse_weights("x=2, q=3,bad", ["x", "y"]) == {"x": 2.0, "y": 1.0}
