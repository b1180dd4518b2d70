"""Readers of loosely formed input."""

from __future__ import annotations

import ast
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.indicators import normalise_cve
from ..session import ship

# File signatures and suffixes by media type.
SIGNATURES = (("%PDF", "application/pdf"), ("<?xml", "application/xml"), ("<!DOCTYPE html", "text/html"), ("<html", "text/html"), ("{", "application/json"), ("[", "application/json"))
SUFFIXES = {"html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml", "rss": "application/rss+xml", "pdf": "application/pdf", "txt": "text/plain"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def json_records(lines: DataFrame, order: str, line: str) -> DataFrame:
    """record_id, text, title, url, published_at of JSON lines; a line that is no object is a record of its own text.

    Ids that are missing become string-<n>, with n the line's place among those that are not blank."""
    kept = lines.filter(F.trim(line) != "").withColumn("_n", F.col(order))
    parsed = F.from_json(F.when(F.trim(line).startswith("{"), F.col(line)), "struct<_id:string,text:string,caps_title:string,title:string,url:string,published_at:string,date_time:string>", {"mode": "PERMISSIVE"})
    rows = kept.select("_n", F.col(line).alias("_line"), parsed.alias("r"), F.when(F.trim(line).startswith("{"), F.try_parse_json(F.col(line)).isNotNull()).otherwise(False).alias("_ok"))
    return rows.select(
        F.when(F.col("_ok"), F.col("r._id")).otherwise(F.concat(F.lit("string-"), F.col("_n").cast("string"))).alias("record_id"),
        F.when(F.col("_ok"), F.col("r.text")).otherwise(F.trim("_line")).alias("text"),
        F.when(F.col("_ok"), F.coalesce("r.caps_title", "r.title")).alias("title"),
        F.when(F.col("_ok"), F.coalesce("r._id", "r.url")).alias("url"),
        F.when(F.col("_ok"), F.coalesce("r.published_at", "r.date_time")).alias("published_at"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and _n of the lines that are not blank: a running number from 0 over all files by name, in the order of their lines.

    A task numbers its own lines; where each block of a file begins comes from a table with a row a block, so the lines are not
    shuffled by a global order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.filter(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    sizes = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_count"))
    own = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_count").over(own), F.lit(0))).drop("_count")
    return lines.join(bases, ["_file", "_block"]).select("value", (F.col("_base") + F.col("_id") - F.col("_first")).alias("_n"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array file or of JSON lines (see json_records). An array that is no JSON gives none."""
    head = spark.read.text(path).filter(F.trim("value") != "").select(F.left(F.trim("value"), F.lit(1)).alias("v")).first()
    if head and head["v"] == "[":
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(array_records(F.col("value"), objects=False)).alias("_n", "value"))
        return json_records(whole, "_n", "value")
    return json_records(numbered_lines(spark, path), "_n", "value")


def array_records(text: Column, objects: bool = True) -> Column:
    """The entries of a JSON array as JSON texts, one level of nested arrays opened; with `objects` those alone that are objects. What is
    no JSON array gives none."""
    root = F.try_parse_json(text)
    entries = lambda v: F.try_variant_get(v, "$", "array<variant>")
    opened = F.flatten(F.transform(entries(root), lambda e: F.when(F.schema_of_variant(e).startswith("ARRAY"), entries(e)).otherwise(F.array(e))))
    kept = F.filter(opened, lambda e: F.schema_of_variant(e).startswith("OBJECT")) if objects else opened
    return F.transform(kept, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(F.to_json(e)))


def repair_json(line: Column) -> Column:
    """Quotes bare keys, writes Python's constants as JSON, drops comments and trailing commas."""
    out = F.regexp_replace(line, r'(?<!")(\b\w+)\s*:', r'"$1":')
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r",(\s*[}\]])", "$1"), r"#.*", ""))


@F.pandas_udf(T.StringType())
def python_literal(lines: pd.Series) -> pd.Series:
    """JSON of a Python literal; null for what is none."""

    def one(line: str | None) -> str | None:
        try:
            return json.dumps(ast.literal_eval(line), default=str) if line else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return lines.map(one)


def repaired_records(lines: DataFrame, line: str, out: str = "record") -> DataFrame:
    """Lines whose repaired form is JSON, else a Python literal, in column `out`; those that are neither go, and so do empty values."""
    fixed = repair_json(F.col(line))
    strict = F.when(F.try_parse_json(fixed).isNotNull(), fixed)
    rows = lines.withColumn(out, strict)
    bad = rows.filter(F.col(out).isNull()).withColumn(out, python_literal(fixed))
    return rows.filter(F.col(out).isNotNull()).unionByName(bad.filter(F.col(out).isNotNull())).filter(~F.trim(out).isin("", "{}", "[]", "null", "false", "0", '""', "0.0"))


def article_text(text: Column, markdown: Column) -> Column:
    """What the entity reader sees of an article."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(markdown, F.lit("")))


def kev_ids(catalogue: DataFrame, text: str = "value") -> DataFrame:
    """cve of all entries of catalogue texts, in canonical form and once each; a text that is no catalogue has none."""
    found = catalogue.select(F.explode(F.from_json(text, "struct<vulnerabilities:array<struct<cveID:string>>>")["vulnerabilities"]).alias("v"))
    return found.select(normalise_cve(F.col("v.cveID")).alias("cve")).filter("cve is not null and cve <> 'CVE-'").distinct()


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a catalogue file; a file that cannot be read gives none."""
    try:
        return kev_ids(spark.read.text(path, wholetext=True))
    except AnalysisException:
        return spark.createDataFrame([], "cve string")


def read_checkpoint(spark: SparkSession, path: str) -> int:
    """The index that write_checkpoint left in a folder, else 0."""
    try:
        row = spark.read.json(path, schema="last_index long").agg(F.max("last_index").alias("n")).first()
    except AnalysisException:
        return 0
    return row["n"] or 0


def write_checkpoint(spark: SparkSession, path: str, index: int) -> None:
    spark.createDataFrame([(index,)], "last_index long").coalesce(1).write.mode("overwrite").json(path)


def verified(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files (path, content) with sha256 and whether it is the expected one (digests: path, expected; others are not)."""
    own = files.withColumn("sha256", F.sha2("content", 256)).join(digests, "path", "left")
    return own.withColumn("verified", F.coalesce(F.col("sha256") == F.lower("expected"), F.lit(False))).drop("expected")


def unzipped(files: DataFrame) -> DataFrame:
    """path, name, data of the entries of archives (path, content); folders and broken archives give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if not name.endswith("/"):
                        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([archive.read(name)], pa.binary())], names=["path", "name", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, data binary")


def url_list(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.trim(line).alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def media_type(head: Column, header: Column, url: Column) -> Column:
    """The header before its semicolon, else by the address's suffix, else by the first bytes; else plain text."""
    by_head = F.coalesce(*(F.when(F.lower(F.trim(head)).startswith(s.lower()), m) for s, m in SIGNATURES))
    suffix = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"/[^/]*\.([a-z0-9]+)$", 1)
    by_suffix = F.coalesce(*(F.when(suffix == s, m) for s, m in SUFFIXES.items()))
    by_header = F.nullif(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))), F.lit(""))
    return F.coalesce(by_header, by_suffix, by_head, F.lit("text/plain"))


def fetched(body: Column, most: int = 5 * 1024 * 1024) -> Column:
    """What is kept of a response: the first bytes, their digest and their base64 form."""
    cut = F.substring(body.cast("binary"), 1, most)
    return F.struct(F.length(cut).alias("n_bytes"), F.sha2(cut, 256).alias("sha256"), F.base64(cut).alias("content_b64"))


def resume(rows: DataFrame, index: str, start: int) -> DataFrame:
    """Rows from a checkpointed index on, then those before it: pass 0 and 1."""
    return rows.withColumn("pass", F.when(F.col(index) >= start, 0).otherwise(1))
