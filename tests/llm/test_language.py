import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import language_id as li

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_scores_equal_plain_naive_bayes(spark, documents):
    texts = {i: ("der hund und die katze " if i % 2 else "the dog and the cat ") * 2 for i in range(8)}
    model = li.fit(documents(texts, {i: "de" if i % 2 else "en" for i in texts}))
    assert model.languages == ["de", "en"] and np.allclose(np.exp(model.blocks[0].astype(float)).sum(axis=0), 1, atol=1e-3)
    grams, starts = li.gram_buckets(["the Hund!", "cat"])
    sums = [model.log_prior + sum(model.blocks[0][g].astype(float) for g in grams[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    best, scores = li.score_texts(pa.array(["the Hund!", "cat"]), model)
    for s, b, score in zip(sums, best, scores, strict=True):
        assert int(np.argmax(s)) == b and np.isclose(score, 1 / np.exp(s - s.max()).sum())


def test_texts_do_not_touch_each_other():
    alone = [li.gram_buckets([t])[0].tolist() for t in ("one two", "", "x", "Üb3r 4!", None)]
    together, starts = li.gram_buckets(["one two", "", "x", "Üb3r 4!", None])
    assert [together[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == alone


def test_edge_cases(spark, documents):
    texts = {1: "the dog", 2: None, 3: "", 4: "123 !!", 5: "the " * 50_000, 6: "le chien et le chat", 7: "le chien", 8: "a dog"}
    docs = documents(texts, {6: "fr", 7: "fr", 5: None})
    model = li.fit(docs)
    got = {r["doc_id"]: r for r in li.predict(docs, model, ["doc_id", "key"]).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4} and got[2]["score"] == 0
    assert got[6]["lang_pred"] == "fr" and got[5]["lang_pred"] == "en"
    nothing = li.fit(docs.limit(0))
    assert {r["lang_pred"] for r in li.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert li.identify(docs.limit(0)).count() == 0


def test_long_texts_in_runs(monkeypatch):
    text = "  Été 12,, the Dog...and... ΣΑΣ ça va 猫 x" * 40
    whole = np.sort(li.gram_buckets([text])[0])
    for size in (7, 64, 1000):
        monkeypatch.setattr(li, "LONG", size)
        parts = np.sort(np.concatenate([g for g, _ in li.long_buckets(np.frombuffer(text.replace("Σ", "s").encode(), np.uint8))]))
        assert (parts == np.sort(li.gram_buckets([text.replace("Σ", "s")])[0])).all() and len(parts) == len(whole)
        rows = list(li.sparse_counts(pa.array([text, "ab", None, text])))
        assert sum(int(n.sum()) for _, _, _, _, n in rows) >= 2 * len(whole)


def test_a_text_of_many_megabytes(spark):
    """Peak memory of one worker's scoring stays far below a dense row per n-gram."""
    import tracemalloc

    model = li.LanguageModel(["a", "b"], [np.zeros((li.BUCKETS, 2), np.float32)], np.log([0.5, 0.5]))
    column = pa.array(["lorem ipsum dolor sit amet " * 800_000])
    tracemalloc.start()
    best, score = li.score_texts(column, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best[0] == 0 and score[0] == 0.5 and peak < 300e6


def test_more_languages_than_a_block(spark, documents):
    texts = {i: chr(0x4E00 + 40 * i) * 5 for i in range(300)}
    docs = documents(texts | {900: None}, {i: f"l{i:03}" for i in texts})
    got = {r["doc_id"]: r for r in li.predict(docs, li.fit(docs), ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == f"l{i:03}" for i in texts) and got[900]["lang_pred"] == "und"


def test_recognised_keeps_all_columns(spark, documents):
    docs = documents({1: "the dog and the cat", 2: "der hund und die katze", 3: None, 4: "12 !", 5: ""}, {2: "de"}).withColumns({c: F.lit("x") for c in ("h1_", "text_", "word_", "score")})
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    left = li.recognised(docs, li.fit(docs), 0.5)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "None", "None"]
    assert li.recognised(docs.limit(0), li.fit(docs), 0.5).count() == 0


def test_memory_of_short_texts():
    """A megabyte of short texts, and one such text, are hashed a part at a time and counted as if they were not."""
    import tracemalloc

    li.is_letter(np.zeros(1, np.uint32))
    for texts in (["the dog and the cat, été "] * 40_000, ["the dog and the cat, été " * 40_000]):
        column = pa.array(texts)
        tracemalloc.start()
        try:
            counts = np.zeros(li.BUCKETS, np.int64)
            for _, _, _, bucket, n in li.sparse_counts(column):
                counts += np.bincount(bucket, n, li.BUCKETS).astype(np.int64)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 40 << 20
        assert (counts == np.bincount(li.gram_buckets(texts)[0], minlength=li.BUCKETS)).all()
