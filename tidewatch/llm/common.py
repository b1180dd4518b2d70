"""Helpers shared by the training-data operators: shared-folder tables, flat text buffers, fixed-size row sieves."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bits of a row sieve. Its broadcast is 1 MiB whatever the input; when it fills up it only lets more rows through.
SIEVE_BITS = 1 << 23
#: Bytes of text handled at once by the numpy kernels; longer documents form a run of their own.
RUN_BYTES = 1 << 21
#: Spark's setting that deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes after which no further row joins an Arrow batch, and its value while stage_table writes: the JVM
#: and its Python worker each hold a batch, and Spark's own 64 MiB would be most of a worker's memory.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one is made only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession):
    """Queries that are made and run inside leave no shuffle files."""
    return _setting(spark, CLEANUP, "true")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and lost executors lose nothing. Shuffle files
    of the write go when the table is there. Python workers get BATCH_BYTES at once."""
    spark = ship(df.sparkSession)
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-{label}"
    with tidy(spark), _setting(spark, BATCH, str(BATCH_BYTES)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that stage_table wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes per core below which an input is dealt out anew, so that a few small files use all cores.
SMALL_BYTES = 1 << 22


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of small inputs, whose files may give fewer partitions than there are cores; others keep their scan
    partitions. The size is the plan's estimate, so nothing runs for it."""
    cores = ship(df.sparkSession).sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores added as it takes to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size, brought to the driver as Arrow batches."""
    with tidy(df.sparkSession):
        table = df.select("*").toArrow()
    out = {name: table.column(name).to_numpy() for name in table.column_names}
    del table
    pa.default_memory_pool().release_unused()
    return out


def release(*shared) -> None:
    """Forgets the values of broadcasts in this worker (they are loaded again if asked for) and gives freed memory back to the system, so
    that an idle worker holds little."""
    for b in shared:
        if hasattr(b, "_value"):
            del b._value
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


def row_runs(bounds: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes sum to most or less; a longer row stands alone."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (multiply and xor-shift, wrapping)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sieve_of(bits: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE_BITS bits with those set whose numbers the only column of `bits` holds.

    Its words are or-ed together by Spark, so the driver receives SIEVE_BITS / 64 rows at most, however many rows there are."""
    bit = F.col(bits.columns[0])
    words = gathered(
        bits.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast({bits.columns[0]} & 63 as int))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    sieve[words["word"].astype(np.int64)] = words["mask"]
    return sieve


def bits_table(spark: SparkSession, sieve: np.ndarray) -> DataFrame:
    """word and mask of a sieve's words that are not 0: SIEVE_BITS / 64 rows at most, small enough to broadcast."""
    at = np.flatnonzero(sieve)
    return ship(spark).createDataFrame(pa.table({"word": pa.array(at, pa.int64()), "mask": pa.array(sieve[at], pa.int64())}))


def id_bit(column: str):
    """The sieve's bit for an id."""
    return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)).alias("bit")


def sieve_words(bits: DataFrame) -> DataFrame:
    """The sieve of sieve_of as a written table of its words that are not 0 (word, mask): it stays with Spark and can be broadcast."""
    bit = bits.columns[0]
    words = bits.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({quoted(bit)} & 63 as int)))").alias("mask"))
    return stage_table(words, "sieve")


def _in_sieve(df: DataFrame, bit: str, words: DataFrame, flag: str) -> DataFrame:
    """df with a flag that tells whether a bit number is in the sieve, whose words are joined as a small broadcast table."""
    word, mask = free(df, "word_", "mask_")
    joined = df.withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(words.toDF(word, mask)), word, "left")
    return joined.withColumn(flag, F.expr(f"coalesce(shiftright({mask}, cast({bit} & 63 as int)) & 1, 0) = 1")).drop(word, mask)


def sieved(df: DataFrame, key: str, words: DataFrame, other: DataFrame | None = None, within: bool = False) -> DataFrame:
    """Rows of df whose key may be in the sieve (of id_bit numbers): no row of a key in it is lost, a few others may pass. With
    another sieve, of these rows those that may be in it (within), or those that are surely not. No Python worker takes part."""
    bit, flag = free(df, "bit_", "flag_")
    out = _in_sieve(df.withColumn(bit, id_bit(key)), bit, words, flag).filter(flag).drop(flag)
    if other is not None:
        out = _in_sieve(out, bit, other, flag).filter(F.col(flag) == F.lit(within)).drop(flag)
    return out.select(*map(quoted, df.columns))


def without(rows: DataFrame, gone: DataFrame, on: list[str], once: bool = False) -> DataFrame:
    """The rows whose columns `on` are in no row of gone (a staged table with these columns; null equals null). With once, of rows
    that agree in `on` and may be in gone one stays: name the repeated ones in gone with a column `again` that is true.

    A sieve of gone is joined as a table of SIEVE_BITS / 64 rows at most. Rows that it does not hit are in no row of gone for
    certain, and pass unshuffled; the few others are joined by key. A full sieve only sends more rows to that join."""
    word, mask, bit = free(rows, "word_", "mask_", "bit_")
    number = lambda: F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    bits = gone.select(number().alias(bit))
    words = bits.groupBy(F.shiftright(bit, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} & 63 as int)))").alias(mask))
    marked = rows.withColumn(bit, number()).withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(words), word, "left")
    hit = F.expr(f"coalesce(shiftright({mask}, cast({bit} & 63 as int)) & 1, 0) = 1")
    certain = marked.filter(~hit).select(*map(quoted, rows.columns))
    maybe = marked.filter(hit).select(*map(quoted, rows.columns))
    if once:
        repeats = gone.filter("again").select(*on)
        gone = gone.filter("not again")
        maybe = _anti(maybe, gone, on)
        single = _anti(maybe, repeats, on)
        return certain.unionByName(single).unionByName(_semi(maybe, repeats, on).dropDuplicates(on))
    return certain.unionByName(_anti(maybe, gone, on))


def _matched(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    names = {c: f"{c}_of_other" for c in on}
    other = other.select(*(F.col(c).alias(n) for c, n in names.items()))
    condition = F.lit(True)
    for c, n in names.items():
        condition &= rows[quoted(c)].eqNullSafe(other[n])
    return rows.join(other, condition, how)


def _anti(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return _matched(rows, other, on, "left_anti")


def _semi(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return _matched(rows, other, on, "left_semi")
