"""Queries beside their DuckDB form on small tables of odd rows."""

import datetime

import duckdb

from tidewatch.plans.registry import ORACLES, QUERIES


def both(spark, folder, name, table, rows, schema):
    """The rows of the query and of its SQL over one table, in order of their columns."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found, other = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    return sorted(tuple(r) for r in found.select(*other.columns).collect()), sorted(other.fetchall())


def test_search_merge_over_texts_without_words(spark, tmp_path):
    rows = [(1, "a clown"), (2, ""), (3, None), (4, "?! -"), (5, "at 227.5.221.1"), (6, "Clown clown at 227.5.221.1"), (7, "小丑")]
    got, want = both(spark, tmp_path, "search_merge", "documents", rows, "doc_id long, text string")
    assert got == want == [(1, 1, 0.5), (5, 0, 1.5), (6, 0, 1.5)]


def test_cve_extract_loose_counts_every_mention(spark, tmp_path):
    day = datetime.date(1998, 5, 6)
    rows = [(day, 10661, 661), (day, 10661, 7), (day, 155, 661), (day, 1066112, 90000)]
    got, want = both(spark, tmp_path, "cve_extract_loose", "lineitem", rows, "l_shipdate date, l_partkey long, l_suppkey long")
    assert got == want and ("CVE-1998-10661", 5) in got
