from pyspark.sql import functions as F

from tidewatch.llm import kneser_ney as kn


def test_frame(spark, documents):
    clean = {i: "the cat sat on the mat and the dog sat on the log. " * (i % 5 + 1) for i in range(200)}
    texts = clean | {900: "@#$%^&*~" * 60, 901: None, 902: "", 903: "the cat sat on the mat and the dog sat on the log. " * 6000, 904: "QZXJ|VWK|" * 40, 905: "the"}
    docs = documents(texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(900, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = kn.fit(kn.trusted_documents(docs, labels))
    got = {r["doc_id"]: r for r in kn.classify(docs, model, ["doc_id", "key"]).collect()}
    assert {i for i, r in got.items() if not r["accepted"]} == {900, 904} and len(got) == len(texts)
    assert got[901]["n_symbols"] == 0 and got[903]["n_symbols"] == len(texts[903])
    none = kn.fit(kn.trusted_documents(docs, labels.limit(0)))
    assert kn.classify(docs, none, ["doc_id"]).filter("accepted").count() == len(texts)
    assert kn.classify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_work_columns_may_clash(spark, documents):
    clean = {i: "the cat sat on the mat and the dog sat on the log. " * (i % 5 + 1) for i in range(100)}
    docs = documents(clean | {900: "@#$%^&*~" * 60}).withColumns({c: F.lit(1) for c in ("n_symbols", "nll", "_text", "_lang", "text_", "lang_", "own_", "limit", "accepted", "h1_", "word_", "bit_")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = kn.fit(kn.trusted_documents(docs, labels))
    got = kn.classify(docs, model, ["doc_id", "n_symbols", "nll", "_text", "lang_", "text_"])
    assert {r["doc_id"] for r in got.filter("not accepted").collect()} == {900}
    left = kn.accepted(docs.unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id = 900")), model)
    assert left.columns == docs.columns and left.count() == 103 and left.filter("doc_id = 900 or text is null").isEmpty()
