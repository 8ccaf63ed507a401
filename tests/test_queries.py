"""Every registered query with a DuckDB equivalent gives the same rows on the smallest tables."""

import os

import pytest

from fathom.plans import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip(f"no tables in {SF}")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_duckdb(spark, duck, name):
    found = core.QUERIES[name](spark, SF)
    relation = duck.sql(core.SQL[name])
    names = sorted(found.columns)
    assert sorted(relation.columns) == names
    places = [relation.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in found.collect()) == sorted(tuple(plain(r[k]) for k in places) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_has_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip(f"no tables in {SF}")
    assert core.QUERIES[name](spark, SF).count() > 0


def test_bootstrap_ci_rests_on_all_draws(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip(f"no tables in {SF}")
    monkeypatch.setattr(core.metrics, "paired_intervals", lambda drawn, *_: drawn)
    assert core.QUERIES["bootstrap_ci"](spark, SF).select("draw").distinct().count() == 2000


def test_registry_works_without_the_optional_parts():
    import __spark_entry__ as registry

    assert set(core.QUERIES) <= set(registry.queries()) and set(core.SQL) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())
