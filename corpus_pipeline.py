"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import best_fit_packing, exact_dedup, kneser_ney, language_id, minhash_dedup
from tidewatch.llm.common import drop_table, read, stage_table
from tidewatch.llm.queries import tokenizer_file

#: Least posterior probability of the predicted language.
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose perplexity under the model of trusted text is within their language's limit.

    Null and empty texts are as typical text and stay; a null language has the limit of all. Equal texts of one language are kept
    or rejected together, whatever their doc_id (null and repeated ones too). Without trusted text all documents stay."""
    model = kneser_ney.fit(kneser_ney.trusted_documents(docs, read(spark, sf_dir, "labels")))
    return kneser_ney.accepted(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows. Those without a letter (null and empty ones too) or without a probable
    language go, and all go if no row names a language to learn. doc_id plays no part but in what is learnt from."""
    return language_id.recognised(docs, language_id.fit(docs.filter(~language_id.held_out())), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest, then the smallest doc_id (null first); of rows that repeat
    both doc_id and text one stays."""
    return exact_dedup.first_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates. Rows without doc_id stay; rows that repeat a doc_id stay or go
    together."""
    return minhash_dedup.first_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 1024 tokens; a row per piece. A null or empty text is a piece of the end id."""
    return best_fit_packing.pack(best_fit_packing.pieces(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("language", language), ("exact", exact), ("near", near), ("packing", packing)]

ORACLE_SQL = None  # perplexity, language scores and token ids are beyond SQL; tests compare with brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table after all stages. Each stage but the last returns all columns of its input as they
    are (any further columns too, whatever their names) and is written as Parquet in the shared folder, where the next one reads
    it; a table that the next stage has read is deleted once nothing needs it. An empty table gives an empty result, texts of any
    length are handled whole, and ties go as each stage says."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), name)
        if k:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
