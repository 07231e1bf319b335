import datetime

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(v, 9) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def test_the_catalogue_works_alone():
    from corpusmill.plans import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_found", lambda name: False)
    assert entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ord", "id", "text", "label", "language"]


def names():
    from corpusmill.plans import catalogue

    return sorted(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, sf, name):
    from corpusmill.plans import catalogue

    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in got.description], got.fetchall())
