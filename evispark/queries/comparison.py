"""Comparator queries: nations as entities, with indicators from customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparator as c
from .base import Registered, Tables

query = Registered()
QUERIES, ORACLE_SQL = query.queries, query.oracles

COLUMNS = ["customers", "cust_bal", "n_orders", "spend", "suppliers", "supp_bal"]
LOWER, HIGHER = ("cust_bal", "supp_bal"), ("customers", "n_orders", "spend", "suppliers")
TARGET = "NATION_0"
WEIGHTS = "customers=2, spend=0.5,unknown=9"


def nations(t: Tables) -> DataFrame:
    """An entity per nation. Customers are summed per nation before orders meet them only by key."""
    cust = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("customers"), F.avg("c_acctbal").alias("cust_bal"))
    orders = (
        t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("o_nation")), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_nation")
        .agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("spend"))
    )
    supp = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("suppliers"), F.avg("s_acctbal").alias("supp_bal"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(cust, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(orders, F.col("n_nationkey") == F.col("o_nation"), "left")
    n = n.join(supp, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select(F.col("n_name").alias("Country"), F.col("r_name").alias("Region"), *COLUMNS)


IND = """
ind AS (
  SELECT n.n_name AS country, r.r_name AS region, c.customers, c.cust_bal, o.n_orders, o.spend, s.suppliers, s.supp_bal
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT c_nationkey AS k, count(*)::DOUBLE AS customers, avg(c_acctbal) AS cust_bal FROM customer GROUP BY 1) c ON c.k = n.n_nationkey
  LEFT JOIN (SELECT c_nationkey AS k, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n.n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, count(*)::DOUBLE AS suppliers, avg(s_acctbal) AS supp_bal FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey
)"""


def _z(source: str) -> str:
    one = "CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END AS z_{c}"
    return f"z AS (SELECT *, {', '.join(one.format(c=x) for x in COLUMNS)} FROM {source})"


def _dist(weights: dict[str, float]) -> str:
    terms = " + ".join(f"coalesce({weights.get(x, 1.0)} * power(a.z_{x} - t.z_{x}, 2), 0.0)" for x in COLUMNS)
    return f"d AS (SELECT a.*, sqrt({terms}) AS distance FROM z a, (SELECT * FROM z WHERE country = '{TARGET}') t WHERE a.country <> '{TARGET}')"


def _top(scored: DataFrame, k: int) -> DataFrame:
    return c.nearest(scored, k).select(F.col("Country").alias("country"), F.round("distance", 6).alias("distance"))


@query(f"WITH {IND}, {_z('ind')} SELECT country, indicator, round(z, 6) AS z FROM (" + " UNION ALL ".join(f"SELECT country, '{x}' AS indicator, z_{x} AS z FROM z" for x in COLUMNS) + ")")
def comparator_zscore(t: Tables) -> DataFrame:
    z = c.zscores(nations(t), COLUMNS)
    long = F.array(*(F.struct(F.lit(x).alias("indicator"), F.round(f"z_{x}", 6).alias("z")) for x in COLUMNS))
    return z.select(F.col("Country").alias("country"), F.inline(long))


@query(f"WITH {IND}, {_z('ind')}, {_dist({})} SELECT country, round(distance, 6) AS distance FROM d ORDER BY d.distance, country LIMIT 20")
def comparator_similarity(t: Tables) -> DataFrame:
    return _top(c.score(nations(t), TARGET, COLUMNS)[0], 20)


@query(f"WITH {IND}, {_z('ind')}, {_dist({'customers': 2.0, 'spend': 0.5})} SELECT country, round(distance, 6) AS distance FROM d ORDER BY d.distance, country LIMIT 10")
def comparator_weighted(t: Tables) -> DataFrame:
    return _top(c.score(nations(t), TARGET, COLUMNS, weights=WEIGHTS)[0], 10)


@query(
    f"WITH {IND}, p AS (SELECT * FROM ind WHERE trim(region) = (SELECT trim(region) FROM ind WHERE country = '{TARGET}')), {_z('p')}, {_dist({})} "
    "SELECT country, round(distance, 6) AS distance FROM d ORDER BY d.distance, country LIMIT 20"
)
def comparator_peer_filtered(t: Tables) -> DataFrame:
    return _top(c.score(nations(t), f" {TARGET.lower()} ", COLUMNS, c.PEER_COLUMNS)[0], 20)


_MESSY = {
    "customers": "CASE WHEN n.n_nationkey % 3 = 0 THEN 'n/a' ELSE CAST(n.n_nationkey * 10 AS VARCHAR) END",
    "spend": "CASE WHEN n.n_nationkey % 4 = 0 THEN 'NaN' ELSE CAST(n.n_nationkey + 5 AS VARCHAR) END",
    "urban": "CASE WHEN n.n_nationkey % 6 = 0 THEN '1,234' ELSE ' 12 ' END",
    "rate": "CASE WHEN n.n_nationkey % 12 = 0 THEN '' ELSE '0.5' END",
}


@query(
    f"WITH m AS (SELECT n_name AS country, {', '.join(f'{v} AS {k}' for k, v in _MESSY.items())} FROM nation n), "
    f"x AS (SELECT country, {', '.join(f'CASE WHEN isnan(try_cast(trim({k}) AS DOUBLE)) THEN NULL ELSE try_cast(trim({k}) AS DOUBLE) END AS {k}' for k in _MESSY)} FROM m), "
    f"y AS (SELECT *, {' + '.join(f'({k} IS NULL)::INT' for k in _MESSY)} AS missing_n FROM x) SELECT * FROM y WHERE missing_n <= 2"
)
def comparator_missingness(t: Tables) -> DataFrame:
    n = t.nation.alias("n")
    raw = n.select(F.col("n_name").alias("country"), *(F.expr(v.replace("VARCHAR", "STRING")).alias(k) for k, v in _MESSY.items()))
    columns = c.numeric_columns(raw, [*_MESSY, "absent"])
    return c.drop_sparse(c.coerce(raw, columns), columns).withColumnRenamed("_missing_n", "missing_n")


_BETTER = " + ".join([f"coalesce((p.{x} < t.{x})::INT, 0)" for x in LOWER] + [f"coalesce((p.{x} > t.{x})::INT, 0)" for x in HIGHER])


@query(
    f"WITH {IND}, {_z('ind')}, {_dist({})}, r AS (SELECT *, row_number() OVER (ORDER BY distance, country) AS rn, count(*) OVER () AS n FROM d), "
    f"b AS (SELECT p.country, p.distance, {_BETTER} AS better_count FROM r p, (SELECT * FROM ind WHERE country = '{TARGET}') t WHERE p.rn <= greatest(floor(p.n * 0.5), 9)) "
    "SELECT country, round(distance, 6) AS distance, better_count FROM b WHERE better_count >= 3 ORDER BY better_count DESC, b.distance, country LIMIT 3"
)
def comparator_aspirational(t: Tables) -> DataFrame:
    scored, target = c.score(nations(t), TARGET, COLUMNS)
    found = c.aspirational(scored, target, 3, LOWER, HIGHER)
    return found.select(F.col("Country").alias("country"), F.round("distance", 6).alias("distance"), "better_count")


@query("""
WITH s AS (SELECT n_name AS country, 'phase' || (o_orderkey % 3 + 2) AS phase, (o_orderkey % 5 % 3)::DOUBLE AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT country, phase, avg(score) AS mean FROM s GROUP BY ALL)
SELECT country, round(sum(mean * CASE phase WHEN 'phase2' THEN 0.3 WHEN 'phase3' THEN 0.4 ELSE 0.3 END), 6) AS weighted_score FROM m GROUP BY country
""")
def phase_weighted_score(t: Tables) -> DataFrame:
    s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_name").alias("country"), F.concat(F.lit("phase"), (F.col("o_orderkey") % 3 + 2).cast("string")).alias("phase"), (F.col("o_orderkey") % 5 % 3).cast("double").alias("score"))
    found = c.phase_weighted_score(s, "country", "phase", "score", {"phase2": 0.3, "phase3": 0.4, "phase4": 0.3})
    return found.select("country", F.round("weighted_score", 6).alias("weighted_score"))
