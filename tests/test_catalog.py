"""Every registered query of the record part against its SQL on the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalog, catalog_code, catalog_copies, catalog_evidence, catalog_findings, catalog_lookups, catalog_records, catalog_reports, catalog_search, catalog_sources  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
