"""Chunkers: fixed stride, sentence-aware, paragraph and token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import relevance
from ..functions.text import context_category, estimate_tokens


def fixed_chunks(documents: DataFrame, tokens: int = 512, overlap: int = 128, heading: str = "body") -> DataFrame:
    """doc_id, chunk_index, offset_start, text, context_category: windows of 4 * tokens characters that overlap, without outer
    blanks. Blank windows are left out; a document without any other gives its whole text once."""
    width, step = tokens * 4, (tokens - overlap) * 4
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - 1, F.lit(0)), F.lit(step))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    segments = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), trim(F.substr("t", i + 1, F.lit(width))).alias("s"))), lambda x: x["s"] != "")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("t").alias("s")))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", segments.alias("s"))
    rows = rows.select("doc_id", F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(whole)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.col("c.at").alias("offset_start"), F.col("c.s").alias("text"), context_category(F.lit(heading), F.col("c.s")).alias("context_category"))


def cut_sentences(text: str | None, most: int = 1200, overlap: int = 150) -> list[tuple[str, int, int]]:
    """Windows of collapsed text that end after the last full stop in their second half, each with start and end."""
    t = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", text or "").strip(" ")
    out, at = [], 0
    while at < len(t):
        stop = min(len(t), at + most)
        dot = t.rfind(". ", at, stop)
        end = dot + 1 if dot >= at + most * 0.5 else stop
        if piece := t[at:end].strip(" "):
            out.append((piece, at, end))
        if end >= len(t):
            break
        at = max(end - overlap, at + 1)
    return out


def sentence_chunks(documents: DataFrame, most: int = 1200, overlap: int = 150) -> DataFrame:
    """doc_id, chunk_index, offset_start, offset_end, text. The cuts depend on the one before, so an Arrow worker makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, b, t) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (t, a, b) in enumerate(cut_sentences(text, most, overlap))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, list(zip(*rows, strict=True)) or [[]] * 5, kinds)), names=["doc_id", "chunk_index", "offset_start", "offset_end", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, offset_start int, offset_end int, text string")


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id, chunk_total and the ids of the chunks before and after."""
    own = Window.partitionBy("doc_id").orderBy("chunk_index")
    chunk_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    out = chunks.withColumn("chunk_id", chunk_id).withColumn("chunk_total", F.count("*").over(Window.partitionBy("doc_id")))
    return out.withColumn("prev_chunk_id", F.lag("chunk_id").over(own)).withColumn("next_chunk_id", F.lit(None).cast("string"))


def paragraph_chunks(text: Column, most_tokens: int = 400) -> Column:
    """Paragraphs put together while their estimated tokens stay within the budget; a longer paragraph goes by sentences.

    A fold over the parts: each state is the chunks so far, the last of them open."""
    parts = F.flatten(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.when(_tokens(p) <= most_tokens, F.array(p)).otherwise(F.split(p, r"(?<=\.)\s+"))))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")
    return pack_parts(parts, most_tokens, "\n\n")


def _tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def pack_parts(parts: Column, most_tokens: int, separator: str) -> Column:
    """Parts put together in order while their tokens stay within the budget (a part that is longer stands alone)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        joined = F.concat(state["open"], F.lit(separator), part)
        fits = _tokens(joined) <= most_tokens
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open")))
            .when(fits, F.struct(state["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def truncate_by_priority(text: Column, most_tokens: int) -> Column:
    """Lines with capitals, ids, addresses, hashes or links first, then the others, as far as the budget goes; in text order."""
    strong = r"CVE-\d{4}-\d+|\b(?:APT|UNC|TA)\d+\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[a-fA-F0-9]{32,64}\b|https?://"
    lines = F.transform(F.split(text, "\n"), lambda l, i: F.struct(F.when(l.rlike(strong) | ((F.upper(l) == l) & (F.lower(l) != l)), 0).otherwise(1).alias("rank"), i.alias("i"), l.alias("line")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,line:string>>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        cost = _tokens(line["line"]) + 1
        fits = state["used"] + cost <= most_tokens
        return F.struct(F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(F.struct(line["i"].alias("i"), line["line"].alias("line"))))).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(F.array_sort(lines), start, step, lambda s: F.array_sort(s["kept"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def sentence_budget_chunks(text: Column, most_tokens: int = 400, overlap_tokens: int = 50) -> Column:
    """Sentences put together while their estimated tokens stay within the budget. A new chunk begins with the last sentences
    of the one before, as far as the overlap goes; a sentence over the budget stands alone after them."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    sized = F.transform(parts, lambda s: F.struct(s.alias("s"), estimate_tokens(s).alias("n")))
    none = F.array().cast("array<struct<s:string,n:bigint>>")
    join = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), " ")

    def tail(opened: Column) -> Column:
        start = F.struct(F.lit(True).alias("on"), F.lit(0).cast("bigint").alias("used"), none.alias("kept"))

        def back(state: Column, x: Column) -> Column:
            fits = state["on"] & (state["used"] + x["n"] <= overlap_tokens)
            return F.when(fits, F.struct(F.lit(True).alias("on"), (state["used"] + x["n"]).alias("used"), F.concat(F.array(x), state["kept"]).alias("kept"))).otherwise(F.struct(F.lit(False).alias("on"), state["used"].alias("used"), state["kept"].alias("kept")))

        return F.aggregate(F.reverse(opened), start, back, lambda s: s["kept"])

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"))

    def step(state: Column, x: Column) -> Column:
        full = (F.size(state["open"]) > 0) & (total(state["open"]) + x["n"] > most_tokens)
        return F.when(full, F.struct(F.concat(state["done"], F.array(join(state["open"]))).alias("done"), F.concat(tail(state["open"]), F.array(x)).alias("open"))).otherwise(F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(x)).alias("open")))

    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(join(s["open"])))).otherwise(s["done"]))


def relevant_chunks(chunks: Column, least: int = 6, separator: str = "\n\n---\n\n") -> Column:
    """The chunks rated relevant enough, put together in order."""
    return F.array_join(F.filter(chunks, lambda c: relevance(c) >= least), separator)
