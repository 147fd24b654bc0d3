import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_heading_amendments_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = entry.queries()["heading_amendments"](spark, SF)
    assert got.count() == orders.count() and got.where("book = '3' AND title IS NOT NULL").count() == orders.where("o_orderkey % 4 = 1").count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/lexweave/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "lexweave.llm" not in open(p).read(), p
