import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from tidewatch.llm import common, exact_dedup, language_id, minhash_dedup

from test_exact_dedup import brute as equal_texts  # noqa: I001
from test_minhash import brute as near_texts

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = out if name == "packing" else corpus_pipeline.stage_table(out, name)
        steps[name] = docs = path
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(steps[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in steps.items()}
    assert not [i for i in ids["start"] - ids["quality"] if labels.get(i) == 1]
    texts = {r["doc_id"]: r["text"] for r in steps["language"].collect()}
    assert ids["exact"] == {i for i, (_, _, kept, _) in equal_texts(texts).items() if kept}
    texts = {i: t for i, t in texts.items() if i in ids["exact"]}
    assert ids["near"] == {i for i, (_, _, kept) in near_texts(texts).items() if kept}
    assert ids["packing"] == ids["near"] and ids["quality"] >= ids["language"]
    assert exact_dedup.BLANK and language_id.UNDETERMINED == "und"


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_filter_stages_on_odd_rows(spark, documents):
    """Null and repeated ids, repeated rows, empty and long texts, empty tables, and columns named like work columns."""
    long = "one two three four five six seven " * 20_000
    docs = documents({1: "a b c d e f g h", 2: "a b c d e f g  h", 3: None, 4: "", 5: long, 6: long + "eight", 7: "quite another text of its own kind"})
    docs = docs.withColumns({c: F.lit("x") for c in ("id_", "h_", "h1_", "word_", "mask_", "bit_", "again", "kept")})
    null = docs.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))
    again = docs.filter("doc_id = 1")
    rows = docs.unionByName(null).unionByName(again).unionByName(again.withColumn("text", F.lit("a text under an id that is taken")))
    left = exact_dedup.first_of_each(rows)
    got = [(r["doc_id"], (r["text"] or "")[:20]) for r in left.collect()]
    assert left.columns == rows.columns
    assert sorted(got, key=str) == sorted([(2, "a b c d e f g  h"), (1, "a text under an id that is taken"[:20]), (3, ""), (5, long[:20]), (6, long[:20]), (None, "quite another text o")], key=str)
    near = minhash_dedup.first_of_each(rows)
    assert near.columns == rows.columns
    ids = [r["doc_id"] for r in near.select("doc_id").collect()]
    assert 2 not in ids and 6 not in ids and ids.count(None) == 1 and {1, 3, 4, 5, 7} <= set(ids)
    for stage in (exact_dedup.first_of_each, minhash_dedup.first_of_each):
        assert stage(rows.limit(0)).count() == 0


def test_workers_of_a_staged_write_get_small_batches(spark):
    """Batches end soon after BATCH_BYTES, no row is lost, and the setting is as before afterwards."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    before = spark.conf.get(common.BATCH)
    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("0123456789"), 300).alias("text"))
    got = common.stage_table(rows.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 6000 and max(r["bytes"] for r in got) < common.BATCH_BYTES + (1 << 20)
    assert spark.conf.get(common.BATCH) == before
