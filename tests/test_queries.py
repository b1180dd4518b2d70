"""Every registered query beside its DuckDB form, as the gate runs them."""

import os

import duckdb
import pytest

from tidewatch.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert len(set(frame.columns)) == len(frame.columns)
        return
    other = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(other.columns)
    assert canonical(rows, frame.columns) == canonical(other.fetchall(), other.columns)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "kind", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
