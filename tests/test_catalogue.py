import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    text = df[cols].astype(object).where(df[cols].notna(), None).map(str)
    return text.sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(found)
        return
    wanted = duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_sql_has_queries():
    assert set(SQL) <= set(catalogue.queries())


def test_sql_needs_no_jars(monkeypatch, tmp_path):
    monkeypatch.setattr("pyspark.__file__", str(tmp_path / "__init__.py"))
    monkeypatch.setattr("zipfile.ZipFile", None)
    assert set(catalogue.oracle_sql()) == set(SQL)
