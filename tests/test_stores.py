import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from tidewatch import api
from tidewatch.functions import budget, fields
from tidewatch.operators import stores
from tidewatch.sources import readers


def test_archives(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a/b.txt", "hello")
        z.writestr("a/", "")
    data = packed.getvalue()
    files = spark.createDataFrame([("x.zip", data), ("bad.zip", b"no"), ("none", None)], "path string, content binary")
    digests = spark.createDataFrame([("x.zip", hashlib.sha256(data).hexdigest().upper()), ("bad.zip", "00")], "path string, expected string")
    assert {r["path"]: r["verified"] for r in readers.verified(files, digests).collect()} == {"x.zip": True, "bad.zip": False, "none": False}
    assert [(r["path"], r["name"], bytes(r["data"])) for r in readers.unzipped(files).collect()] == [("x.zip", "a/b.txt", b"hello")]


def test_records_are_numbered_over_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"_id":"q","text":"t"}\n\nplain\n')
    (folder / "b.jsonl").write_text("more\n{bad\n")
    got = [(r["record_id"], r["text"]) for r in readers.read_records(spark, str(folder)).orderBy("record_id").collect()]
    assert got == [("q", "t"), ("string-1", "plain"), ("string-2", "more"), ("string-3", "{bad")]
    (tmp_path / "c.json").write_text('[{"_id":"z","text":"u"}, "word", [{"text":"v"}]]')
    rows = {r["text"]: r["record_id"] for r in readers.read_records(spark, str(tmp_path / "c.json")).collect()}
    assert rows["u"] == "z" and rows["word"] == "string-1" and "v" in rows


def test_checkpoints_and_catalogues(spark, tmp_path):
    path = str(tmp_path / "point")
    assert readers.read_checkpoint(spark, path) == 0
    readers.write_checkpoint(spark, path, 41)
    assert readers.read_checkpoint(spark, path) == 41
    assert readers.read_kev(spark, str(tmp_path / "none.json")).count() == 0


def test_tables(spark):
    stores.recreate(spark, "points_t", "id STRING, n INT")
    stores.ensure(spark, "points_t", "id STRING, n INT")
    spark.sql("INSERT INTO points_t VALUES ('a', 1)")
    assert spark.table("points_t").count() == 1
    stores.wipe(spark, "points_t")
    assert spark.table("points_t").count() == 0
    stores.drop(spark, "points_t")
    assert not spark.catalog.tableExists("points_t")


def test_emission_takes_the_first_locator(spark):
    def down(rows):
        raise OSError("down")

    rows, seen = spark.range(2), []
    assert stores.emit(rows, [down, lambda r: seen.append(r.count()) or "local", lambda r: seen.append(0) or "far"]) == "local" and seen == [2, 0]


def test_vectors_of_another_size_fail(spark):
    import pytest
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    with pytest.raises(PySparkException):
        rows.select(F.size(fields.checked_vector(F.col("v"), 2))).collect()


def test_budgets():
    lines = "HEADER\nplain words here\nCVE-2024-1111 seen\n" + "filler text of no weight " * 60
    cut = budget.structured_cut(lines, 100)
    assert cut.split("\n")[:3] == ["HEADER", "CVE-2024-1111 seen", "plain words here"] and cut.endswith("...") and budget.tokens(cut) <= 110
    assert budget.truncate("short", 10) == "short" and budget.prepare(None, 5)[1] == "empty"
    text = "\n\n".join(f"Paragraph {i} of malware news. " + "word " * 80 for i in range(30)) + "\n\nnothing of note " * 40
    out, name, before, after, chunks, kept = budget.prepare(text, 400)
    assert name == "chunked_classified_summarized" and before > after and chunks >= kept > 0
    assert budget.prepare("quiet " * 3000, 100)[0] == budget.P.NO_RELEVANT
    assert "Cves: CVE-2024-0001" in budget.context_summary("Title\n" + "about CVE-2024-0001 " * 400, 200)
    assert fields.token_limit("entity") == 4000 and fields.token_limit("odd", {"LLM_DEFAULT_MAX_TOKENS": "12"}) == 12 and fields.token_limit("cyber", {"LLM_CYBER_MAX_TOKENS": "x"}) == 3000


def test_service(spark):
    docs = spark.createDataFrame([(1, "cheese at 1.2.3.4", "a"), (2, "wine and cheese", None), (3, "bread", "b")], "doc_id long, text string, tags string")
    rows = [tuple(r) for r in api.respond(docs, "cheese 1.2.3.4", limit=2).collect()]
    assert rows[0][0] == "cheese at 1.2.3.4" and rows[0][1] == 1.5 and rows[0][2] == ["a"] and rows[1][2] == []
    assert [r["doc_id"] for r in api.query(docs, "cheese", limit=5, has_ioc=True).collect()] == [1]
    assert set(api.schemas()) == set(api.TOOLS) and "text" in api.schemas()["detect_kind"]["inputSchema"]["required"] and len(api.CAPABILITIES) == 18
    found = api.entities_of(spark.createDataFrame([("APT28 dropped Emotet and emotet, says UNC12",)], "text string")).first()
    assert found["malware"] == ["Emotet"] and found["threat_actors"] == ["APT28", "UNC12"]
    short = api.summarise(spark.createDataFrame([("Title\nA zero-day. Apply the patch.",)], "text string")).first()
    assert short["title"] == "Title" and short["zero_day_mention"] and short["recommendations_and_mitigations"] == ["Apply the patch."]
    assert json.loads(spark.range(1).select(stores.result_line("id")).first()[0]) == {"id": 0}
