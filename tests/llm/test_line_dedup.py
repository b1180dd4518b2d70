import random

import duckdb
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, queries


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    places = [(d, i, line) for d in sorted(texts) for i, line in enumerate((texts[d] or "").split("\n")) if line.strip(" ")]
    gone = set()
    for k, (d, i, line) in enumerate(places):
        for _, _, other in places[:k]:
            if line == other or distance_within_one(line, other):
                gone.add((d, i))
                break
    return gone


def test_equals_brute_force(spark, documents):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((3, 5, 9, 20, 21, 40, 90)))).strip() + "." for _ in range(25)]

    def change(line):
        i = rng.randrange(len(line) + 1)
        return rng.choice((line, line[:i] + "z" + line[i:], line[:i] + line[i + 1 :], line[:i] + "q" + line[i + 1 :], line[:i] + "zz" + line[i:], line[: i // 2] + "z" + line[i // 2 :][: i] + "z"))

    texts = {i: "\n".join(change(rng.choice(base)) for _ in range(rng.randrange(1, 9))) for i in range(60)}
    texts |= {90: None, 91: "", 92: "\n\n", 93: "short\nshort\nshorts", 94: "hot line that is everywhere", 95: "x" * 3000, 96: "x" * 3001, 97: "x" * 2999 + "y", 98: "  ", 99: "tail\n", 88: "x\nqrst\nqrs\nxy\nqrzt", 89: "1234\n12345\n123456"}
    texts |= {i: "hot line that is everywhere\nown %d of its kind, truly" % (i * 7919) for i in range(100, 140)}
    docs = documents(texts)
    gone = brute(texts)
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.duplicate_lines(docs).collect()} == gone
    for r in line_dedup.dedup_lines(docs).collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        kept = [x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["text"] == ("\n".join(kept) if texts[r["doc_id"]] is not None else None) and r["key"] == "k"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, documents, monkeypatch):
    """Neither the plan of the result nor those of the tables written on the way."""
    plans, write = [], line_dedup.stage_table
    note = lambda df: plans.append(df._jdf.queryExecution().toString()) or df
    monkeypatch.setattr(line_dedup, "stage_table", lambda df, label: write(note(df), label))
    note(line_dedup.dedup_lines(documents({1: "a\nb"})))
    assert len(plans) > 8 and not [p for p in plans if "Python" in p or "Pandas" in p or "Arrow" in p]


def test_work_columns_may_clash(spark, documents):
    docs = documents({1: "one line here\nanother", 2: "one line herd", 3: None}).withColumns({c: F.lit("x") for c in ("_doc", "_dropped", "doc_", "dropped_", "line", "h1", "first", "place")})
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"]) == ("one line here\nanother", "", None) and got[2]["_doc"] == "x" and got[2]["dropped_"] == "x"


def test_query_counts_edits_in_bytes_as_its_sql(spark, tmp_path):
    """A pair of a key that is near in characters only must not hide a later pair that is near in bytes."""
    lines = ["Ére.", "Are.", "Ere.", "été", "étè", "ete", "ét", "x€", "x¢", "x₭", "x", "小猫 runs", "小狗 runs", "小猫 run", "a😀b", "a😁b", "ab", "ñ", "n", "Ñ", "ñ ", "é" * 300, "é" * 299 + "e", "é" * 299 + "è", "é" * 299]
    rows = [(i, line) for i, line in enumerate(lines)] + [(90, None), (91, ""), (92, "\n".join(reversed(lines)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    other = con.sql(queries.ORACLES["op9_line_dedup"])
    assert sorted(map(tuple, queries.op9_line_dedup(spark, str(tmp_path)).select(*other.columns).collect())) == sorted(other.fetchall())
    dropped = {r["doc_id"] for r in line_dedup.duplicate_lines(spark.createDataFrame(rows[:3], "doc_id long, text string"), "byte").collect()}
    assert dropped == {2} and {r["doc_id"] for r in line_dedup.duplicate_lines(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()} == {1, 2}
