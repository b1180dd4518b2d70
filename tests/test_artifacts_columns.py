import hashlib

import duckdb

from tidewatch.plans import registry
from tidewatch.plans.artifacts import artifacts

TEXTS = [(1, "APT29 used CVE-2024-1234 against 8.8.8.8 and evil.example.com, technique T1059 (phishing)\nransom"), (2, ""), (3, None), (4, "plain words")]


def test_every_column_is_returned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, x, "s") for i, x in TEXTS], "doc_id long, text string, source string")
    monkeypatch.setattr(registry.readers, "table", lambda *_: docs)
    got = {r["doc_id"]: r for r in registry.QUERIES["artifacts_columns"](spark, "").collect()}
    plain = artifacts(docs).collect()
    assert len(got) == len(plain) == 4 and plain[0]["cves"]
    for row in plain:
        for name, value in row.asDict().items():
            if isinstance(value, list):
                assert got[row["doc_id"]][f"n_{name}"] == len(value)
                value = hashlib.sha256("\n".join(value).encode()).hexdigest()
            assert got[row["doc_id"]][name] == value


def test_empty_and_null_texts_equal_the_sql(spark, monkeypatch):
    docs = spark.createDataFrame([(i, x, "s") for i, x in TEXTS], "doc_id long, text string, source string")
    monkeypatch.setattr(registry.readers, "table", lambda *_: docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 's')", TEXTS)
    rows = registry.QUERIES["artifacts_pipeline"](spark, "").collect()
    assert sorted(tuple(r) for r in rows) == sorted(con.sql(registry.ORACLES["artifacts_pipeline"]).fetchall())
