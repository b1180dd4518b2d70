"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import free, gathered, mix64, stage_table

#: Cells over which rows are numbered. Their counts, at most this many rows, are all that the numbering gathers.
CELLS = 4096


def feistel(numbers: np.ndarray, size: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A permutation of range(size), as of a seed, at the numbers given.

    The network permutes the least even number of bits that holds size; a value that falls outside is encrypted again
    (cycle walking) until it is inside, which keeps it a permutation."""
    if size <= 1:
        return np.zeros_like(numbers)
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))

    def encrypt(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & mask)
        return left << shift | right

    out = encrypt(numbers.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(size))).size:
        out[outside] = encrypt(out[outside])
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, key_columns: list[str], shards: int, seed: int = 20240) -> DataFrame:
    """Adds row_number, shard and slot: a seeded shuffle of all rows, dealt over shards so that counts differ by one at most.

    Rows are numbered by cell (a hash of the key columns) and by the key columns within a cell, so the numbers depend on
    the rows alone, not on files or partitions. With p = permutation(number), shard is p mod shards and slot p div shards, so
    slots are gapless from 0. Equal keys are interchangeable: rows repeated in all key columns share the places that they
    take among them. Nulls are keys like any other; an empty table gives an empty result. Columns named row_number, shard or slot are
    replaced; any other column is left alone, as work columns take names that are free."""
    keys = free(rows, *(f"key{k}_" for k in range(len(key_columns))))
    rows = rows.withColumns(dict(zip(keys, map(F.col, key_columns), strict=True))).drop("row_number", "shard", "slot")
    cell, start, place = free(rows, "cell_", "start_", "place_")
    dealt = stage_table(rows.withColumn(cell, F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")), "numbered")
    counts = gathered(dealt.groupBy(cell).count())  # CELLS rows at most
    sizes = np.zeros(CELLS, np.int64)
    sizes[counts[cell].astype(int)] = counts["count"]
    total = int(sizes.sum())
    table = rows.sparkSession.createDataFrame(pa.table({cell: pa.array(np.arange(CELLS), pa.int32()), start: pa.array(sizes.cumsum() - sizes)}))

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(np.int64), total, seed))

    order = Window.partitionBy(cell).orderBy(*keys)
    numbered = dealt.withColumn("row_number", F.row_number().over(order).cast("long") - 1).join(F.broadcast(table), cell)
    return (
        numbered.withColumn("row_number", F.col("row_number") + F.col(start))
        .withColumn(place, permuted("row_number"))
        .withColumn("shard", (F.col(place) % shards).cast("int"))
        .withColumn("slot", F.expr(f"{place} div {shards}"))
        .drop(cell, start, place, *keys)
    )


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 20240) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, under the law `rows`.

    size is the UTF-8 bytes of the text plus 1 (null: 1), text_crc32 the CRC of those bytes (null: of none). grown_shard is
    null under this law. Other columns of the input are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
