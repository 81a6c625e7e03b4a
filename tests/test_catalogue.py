"""Registered queries against their SQL, over the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from lattica.catalogue import CATALOGUE

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
WITH_SQL = sorted(name for name, query in CATALOGUE.items() if query.sql and name != "minimum_spanning_forest")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, found):
    return sorted((tuple(r[c] for c in sorted(columns)) for r in found), key=repr)


@pytest.fixture(scope="module")
def answers(spark):
    """The columns and rows of each query, as futures: four at a time, since small jobs mostly wait."""

    def run(name):
        df = CATALOGUE[name].run(spark, DATA)
        return df.columns, [r.asDict() for r in df.collect()]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in WITH_SQL}
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(answers, db, name):
    found, got = answers[name].result()
    answer = db.execute(CATALOGUE[name].sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(found)
    assert rows(columns, got) == rows(columns, [dict(zip(columns, r)) for r in answer.fetchall()])
