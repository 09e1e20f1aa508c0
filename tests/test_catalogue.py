"""Every catalogue query runs, and agrees with its SQL where it has one."""

import os

import pytest

from tallybridge.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["score_weighted", "summary", "tag_histogram", "unicode_reports", "blocked_candidates"])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
