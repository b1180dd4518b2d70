import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import chunking, entities, parsing, relational, search
from tidewatch.plans.artifacts import artifacts
from tidewatch.sources import readers, writers


def test_sentence_chunks():
    assert chunking.cut_sentences(None) == [] and chunking.cut_sentences(" \n ") == []
    t = ("word " * 180).strip() + ". " + "tail " * 100
    first, second = chunking.cut_sentences(t)[:2]
    assert first[0].endswith("word.") and second[1] == first[2] - 150


def test_fixed_chunks_never_empty(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 3000)], "doc_id long, text string")
    rows = [(r["doc_id"], r["offset_start"], len(r["text"])) for r in chunking.fixed_chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(1, 0, 0), (2, 0, 0), (3, 0, 2048), (3, 1536, 1464)]


def test_budgets(spark):
    t = "\n\n".join(["a" * 40] * 5 + ["b. " * 30])
    got = spark.range(1).select(chunking.paragraph_chunks(F.lit(t), 22).alias("c"), chunking.truncate_by_priority(F.lit("low\nCVE-2020-1\nlow2 " + "x" * 90), 6).alias("t")).first()
    assert all(len(c) // 4 <= 22 for c in got["c"]) and "".join(got["c"]).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "")
    assert got["t"] == "low\nCVE-2020-1"


def test_sentence_budget_and_relevance(spark):
    t = " ".join(f"Sentence number {i} has some words." for i in range(12))
    run = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    got = run(chunking.sentence_budget_chunks(F.lit(t), 30, 10))
    assert got[0].startswith("Sentence number 0") and got[-1].endswith("11 has some words.") and len(got) > 2
    assert all(b.startswith(a.rsplit("Sentence", 1)[1].join(["Sentence", ""])) for a, b in zip(got, got[1:], strict=False))
    assert run(chunking.sentence_budget_chunks(F.lit(""), 30, 10)) == []
    assert run(chunking.relevant_chunks(F.array(F.lit("tea"), F.lit("a phishing mail"), F.lit("CVE-2020-1")), 6, "|")) == "a phishing mail|CVE-2020-1"


def test_smart_distinct(spark):
    rows = spark.createDataFrame([(0, "Cobalt-Strike"), (1, "cobalt strike  "), (2, "Cobalt_Strike."), (3, " ")], "pos long, name string")
    got = relational.smart_distinct(rows, "name", F.col("pos")).collect()
    assert [(r["name"], r["position"], r["variants"]) for r in got] == [("Cobalt_Strike.", 0, 3)]


def test_upsert_and_merge(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), (None, 4)], "id string, v int")
    assert sorted(tuple(r) for r in relational.upsert(table, new.filter("id is not null"), "id").collect()) == [("a", 1), ("b", 3)]
    ids = [r["id"] for r in relational.merge_sources(table, new).collect()]
    assert len(set(ids)) == 4 and sum(len(i) == 64 for i in ids) == 2


def test_severity_rollup(spark):
    rows = spark.createDataFrame([("k", "LOW", 2.0, False, True), ("k", "NOT_ENRICHED", 9.9, False, False), ("k", "HIGH", 7.0, True, False)], "key string, severity string, score double, exploited boolean, patched boolean")
    r = relational.severity_rollup(rows, "key").first()
    assert (r["severity"], r["score"], r["exploited"], r["patched"]) == ("HIGH", 9.9, True, True)


def test_heal(spark):
    rows = spark.createDataFrame([(None, "a, b,a", "YES", "x"), ("t", None, None, "2")], "s string, l string, f string, n string")
    got = [tuple(r) for r in relational.heal(rows, strings=["s"], lists=["l"], flags=["f"], numbers=["n"]).collect()]
    assert got == [("", ["a", "b"], True, 0.0), ("t", [], False, 2.0)]


def test_embedding_is_a_unit_vector(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, "beta")], "doc_id long, text string")
    norms = {r["doc_id"]: r["s"] for r in search.embed(rows, "doc_id", "text").groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()}
    assert set(norms) == {1, 3} and all(v == pytest.approx(1) for v in norms.values())


def test_hybrid_search_puts_exact_hits_first(spark):
    docs = spark.createDataFrame([(1, "all about cheese"), (2, "host 203.0.113.10 seen"), (3, "cheese and wine")], "doc_id long, text string")
    got = [(r["doc_id"], r["stage"]) for r in search.hybrid_search(docs, "cheese 203.0.113.10", 2).collect()]
    assert got[0] == (2, 0) and got[1][1] == 1


def test_spans_and_tags():
    t = "See (CVE-2021-44228), lockbit by APT28 at IP: 8.8.8.8."
    assert [(t[a:b], label) for a, b, label in entities.find_spans(t)] == [("CVE-2021-44228", "CVE"), ("lockbit", "MALWARE"), ("APT28", "THREAT_ACTOR"), ("8.8.8.8", "IP")]
    assert ("APT28", "B-THREAT_ACTOR") in entities.tag_tokens(t) and entities.find_spans(None) == []
    assert entities.align_labels([None, 0, 0, 1, None], [5, 6]) == [-100, 5, -100, 6, -100]


def test_json():
    assert parsing.normalised_json('{"a":{"b":[1,"x",{}]},"c":null}')[1] == [("a.b.0", "1"), ("a.b.1", "x"), ("c", "null")]
    assert parsing.normalised_json("nope") is None
    deep = json.loads('{"k":' * 40 + "1" + "}" * 40)
    assert parsing.flatten_json(deep) == [(".".join("k" * 40), 1)]
    pairs = [(f"k{i}", "v") for i in range(900)] + [(f"x.title{i}", "v") for i in range(200)] + [("y.title", "v")]
    assert parsing.limit_keys(pairs, ("title",), 1000)[0] == ("x.title0", "v")


def test_markdown():
    title, body = parsing.page_markdown("<html><title> T </title><body><nav>no</nav><h2>H</h2><p>a <a href='/x'>b</a></p><ul><li>c</li></ul><script>z</script></body>")
    assert title == "T" and body == "## H\n\na [b](/x)\n\n- c"


def test_threat_sharing_text(spark):
    stix = '{"type":"bundle","objects":[{"type":"indicator","id":"i","name":"N","pattern":"[ipv4-addr:value = \'1.2.3.4\']"}]}'
    misp = '{"Event":{"info":"I","Attribute":[{"type":"ip","value":"1.1.1.1","comment":"c"}]}}'
    got = spark.range(1).select(parsing.stix_text(F.lit(stix)).alias("s"), parsing.misp_text(F.lit(misp)).alias("m")).first()
    assert got["s"] == "N\nSTIX_INDICATOR_PATTERN: [ipv4-addr:value = '1.2.3.4']" and got["m"] == "I\n1.1.1.1\nc"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"_id":"a","text":"t"}\n\nnot json\n{"broken": \n')
    got = {(r["record_id"][:6], r["text"]) for r in readers.read_records(spark, str(tmp_path / "l.jsonl")).collect()}
    assert ("a", "t") in got and ("string", "not json") in got and len(got) == 3
    (tmp_path / "a.json").write_text('[{"_id":"x","text":"1"},{"_id":"y","text":"2"}]')
    assert {r["record_id"] for r in readers.read_records(spark, str(tmp_path / "a.json")).collect()} == {"x", "y"}
    frame = spark.createDataFrame([(2, "b", None)], "z int, a string, n string")
    writers.write_json(frame, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"b","z":2}']
    writers.write_table(frame.drop("n"), str(tmp_path / "t"), partition=["z"], bloom=["a"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    tagged = spark.createDataFrame([([("a", "O"), ("b", "B-X")],)], "tokens array<struct<token:string,tag:string>>")
    writers.write_bio(tagged, str(tmp_path / "bio"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bio")).collect()] == ["a O", "b B-X", ""]


def test_media_type(spark):
    f = lambda head, header, url: spark.range(1).select(readers.media_type(F.lit(head), F.lit(header).cast("string"), F.lit(url))).first()[0]
    assert [f("%PDF-", None, "u"), f("x", "text/css; a", "u"), f("x", None, "http://h/a.json?x"), f("x", None, "u")] == ["application/pdf", "text/css", "application/json", "text/plain"]


def test_artifacts_heal_and_rate(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "s", "Title\nCVE-2021-44228 ransom")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in artifacts(docs).collect()}
    assert got[1]["cves"] == [] and got[1]["completeness"] < got[2]["completeness"] and got[2]["title"] == "Title" and "title" in got[1]["missing"]


def test_candidates_and_extraction(spark):
    from tidewatch.functions import candidates

    t = "Block 203.0.113.0/24 and 203.0.113.0, 8.8.8.8, 10.0.0.1; c2 beacon evil[.]com www.good.org com.google.maps.app setup.exe STIX_INDICATOR_PATTERN: [domain-name:value = 'p.qq'] STIX_INDICATOR_PATTERN: [x509-certificate:serial_number = '4c:b'] " + "x" * 300 + " 192.168.7.7"
    run = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert run(candidates.ip_candidates(F.lit(t))) == ["203.0.113.0/24", "8.8.8.8", "10.0.0.1"]
    found = lambda x, u: candidates.extract(spark.createDataFrame([(x, u)], "text string, url string"), source_url="url").first()
    got = found(t, "http://www.good.org/x")
    assert got["ips"] == ["8.8.8.8"] and [r["ip"] for r in got["non_routable"]] == ["203.0.113.0/24", "10.0.0.1"]
    assert "evil.com" in got["domains"] and "p.qq" in got["domains"] and "good.org" not in got["domains"] and not any("google" in d for d in got["domains"])
    assert run(candidates.accept(F.lit("a.tk"), F.lit("tea"))) and not run(candidates.accept(F.lit("plain.org"), F.lit("tea")))
    assert not run(candidates.accept(F.lit("https://x.gov"), F.lit("an attack")))
    assert run(candidates.products(F.lit("CVE-2020-1 hits Apache Struts"), F.lit("cve-2020-1"))) == ["Apache Struts"]
    assert [run(candidates.valid_url(F.lit(u))) for u in ("http://a.bc/c", "http://nodot/", "http:///x", "ftp://a.bc", "https://1.2.3.4/")] == [True, False, False, False, True]
    assert found(None, None)["urls"] == []


def test_ipv6(spark):
    from tidewatch.operators import addresses

    assert [addresses.rate_ipv6(x)[2] for x in ("::1", "fe80::1", "fd00::1", "::", "ff02::1", "2001:db8::1", "::ffff:10.0.0.1", "2606:4700::1", "nope", None)] == ["Loopback", "Link-local", "Private", "Special", "Multicast", "Documentation", "IPv4-mapped", "Public", "Invalid", "Invalid"]
    got = spark.createDataFrame([("2606:4700:0:0::1",), ("x",)], "ip string").select(addresses.compress_ipv6("ip").alias("c"), addresses.classify_ipv6("ip")["kind"].alias("k")).collect()
    assert [tuple(r) for r in got] == [("2606:4700::1", "Public"), ("x", "Invalid")]


def test_service_functions(spark):
    from tidewatch import api

    assert api.version()["name"] == "tidewatch" and api.health() == {"ok": True} and len(api.TOOLS) == 21
    docs = spark.createDataFrame([(1, "cheese", "s"), (2, "wine", "t")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        api.query(docs, " ")
    assert [r["doc_id"] for r in api.query(docs, "cheese wine", source="t").collect()] == [2]
    art = spark.createDataFrame([("u", "c", "T", None, "m", None, ["x", "tenant:acme"], ["T1055"], (["h"], ["d"], None, None), ([("CVE-1",)], "HIGH", True, None))], "source_url string, content_sha256 string, title string, summary string, markdown string, published_at string, tags array<string>, mitre_ttps array<string>, iocs struct<urls:array<string>,domains:array<string>,ips:array<string>,hashes:array<string>>, cve struct<vulnerabilities:array<struct<id:string>>,highest_severity:string,active_exploitation:boolean,patch_availability:boolean>")
    points = api.artifact_points(art)
    assert points.first()["text"] == "T\n\nm\nT1055\nh d\nCVE-1"
    assert api.by_cves(points, "acme", ["CVE-1", "CVE-2"]).count() == 1 and api.by_cves(points).count() == 0
    table = spark.createDataFrame([("7", "old")], "id string, text string")
    after = api.ingest(table, spark.createDataFrame([("007", "a"), ("7", "b"), ("doc:0", "c")], "id string, text string"))
    assert after.count() == 2 and after.filter("id = '7'").first()["text"] in ("a", "b")
    assert "refang" in api.register_all(spark) and spark.sql("SELECT refang('hxxp://a[.]b') AS v").first()["v"] == "http://a.b"
