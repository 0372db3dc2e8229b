import duckdb
import pytest

from evispark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return columns, sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_what_sql_gives(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(queries.ORACLE_SQL[name]).df())
