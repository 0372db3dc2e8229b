from types import SimpleNamespace

from evispark.queries.documents import dim_cartesian


def test_no_segment_is_lost(spark):
    t = SimpleNamespace(customer=spark.range(1500).selectExpr("concat('s', id) AS c_mktsegment"), region=spark.sql("SELECT 'r' AS r_name"))
    assert dim_cartesian(t).count() == 1500
