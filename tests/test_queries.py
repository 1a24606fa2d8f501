"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pytest

import pacelake.queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def rows(table, names):
    return sorted(repr(list(r.values())) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got = own.QUERIES[name](spark, FOLDER).toArrow()
    want = duck.execute(own.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL)))
def test_runs_and_is_repeatable(spark, name):
    first, again = (own.QUERIES[name](spark, FOLDER).toArrow() for _ in range(2))
    assert first.num_rows > 0
    assert rows(first, sorted(first.column_names)) == rows(again, sorted(again.column_names))


def test_every_oracle_has_its_query():
    assert set(own.ORACLE_SQL) <= set(own.QUERIES)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(own.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
