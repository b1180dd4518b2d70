"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, bits_table, free, sieve_of, spread, stage_table, without

#: Two primes below 2^31 and a base for each: a fingerprint is a pair of residues, 62 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245 % PRIMES[0], 1220703125 % PRIMES[1])
#: Bytes of a chunk that is hashed on its own.
CHUNK = 1 << 12
#: Bytes of a chunk in the comparison of equal fingerprints.
COMPARED = 1 << 16
#: Characters that normalisation deletes: space and U+0009 to U+000D.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def _powers() -> tuple[np.ndarray, ...]:
    """base^0 .. base^CHUNK-1 in descending order, split into 16-bit halves so that products with bytes are exact in float64."""
    halves = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        row = np.empty(CHUNK, np.int64)
        row[0] = 1
        for i in range(1, CHUNK):
            row[i] = row[i - 1] * base % prime
        row = row[::-1]
        halves += [row >> 16, row & 0xFFFF]
    return tuple(halves)


_WEIGHTS = np.stack(_powers(), axis=1).astype(np.float64)
_SHIFTS = tuple(pow(base, CHUNK, prime) for prime, base in zip(PRIMES, BASES, strict=True))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint (residue, residue, length) of two texts put together, from their own: the left one is shifted by the right one's length.
    It is associative, so chunks may be hashed anywhere and combined in any bracketing."""
    n = right[2]
    return (*((left[i] * pow(BASES[i], n, PRIMES[i]) + right[i]) % PRIMES[i] for i in (0, 1)), left[2] + n)


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """Fingerprint of data. Its whole chunks are hashed together as rows of a matrix, then folded with the length-shifted rule."""
    whole = len(data) // CHUNK * CHUNK
    rest = np.frombuffer(data, np.uint8, offset=whole)
    out = [0, 0]
    if whole:
        chunks = np.frombuffer(data, np.uint8, whole).reshape(-1, CHUNK)
        sums = np.concatenate([chunks[i : i + 256].astype(np.float64) @ _WEIGHTS for i in range(0, len(chunks), 256)]).astype(np.int64)
        for i, prime in enumerate(PRIMES):
            part, acc = ((sums[:, 2 * i] % prime << 16) + sums[:, 2 * i + 1]) % prime, 0
            for x in part.tolist():
                acc = (acc * _SHIFTS[i] + x) % prime
            out[i] = acc
    sums = rest.astype(np.float64) @ _WEIGHTS[CHUNK - len(rest) :]
    tail = tuple(((int(sums[2 * i]) % prime << 16) + int(sums[2 * i + 1])) % prime for i, prime in enumerate(PRIMES))
    return combine((*out, whole), (*tail, len(rest)))


_MARKS = "doc_id long, text_hash long, fp long, n_bytes long, n_chars long, text_sha256 string"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANK)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            f1, f2, n = fingerprint(data := normalised(text))
            rows.append((f1 << 31 | f2, n, len(text or ""), hashlib.sha256(data).hexdigest()))
        parts = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, parts, kinds)], names=["doc_id", "text_hash", "fp", "n_bytes", "n_chars", "text_sha256"])


def _chunks(shared) -> Callable:
    """Of texts whose fingerprint may be shared, the chunks: a few MB of them at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, rows, held = shared.value, [], 0
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)), names=["fp", "n_bytes", "chunk", "part"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                f1, f2, n = fingerprint(data := normalised(text))
                bit = (fp := f1 << 31 | f2) % SIEVE_BITS
                if not int(sieve[bit >> 6]) >> (bit & 63) & 1:
                    continue
                for k in range(0, max(1, n), COMPARED):
                    rows.append((fp, n, k // COMPARED, data[k : k + COMPARED]))
                    held += len(rows[-1][3]) + 100
                    if held > 1 << 22:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return cut


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars, text_hash.

    Texts are equal when they are so without the characters of BLANK; null counts as empty. Of equal texts, the one with the
    most code points, then the smallest doc_id, stays. Groups form on fingerprint and length; where more than one document
    shares these, the texts are compared chunk by chunk: a group is one text only if for every chunk number the least and the
    greatest chunk are the same bytes. That is an aggregation with a partial sum in each task, so a group that holds a third
    of all rows never meets in one task. Groups that fail are split by SHA-256. Groups go back to their members by a join of
    a written table, whose hot keys Spark splits; a document that is alone in its group, as the sieve tells of most, has no part
    in that join. Rows that repeat a doc_id share their group's keep_id and are each marked kept if it is their own; a row
    without doc_id comes before all others of its group. An empty table gives an empty result; columns other than doc_id and
    text are ignored; a text of any length is hashed and compared whole."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    marks = stage_table(spread(docs).mapInArrow(_marks, _MARKS), "marks")
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), "doc_id")).alias("best")
    shared = stage_table(marks.groupBy("fp", "n_bytes").agg(F.count("*").alias("group_size"), best).filter("group_size > 1"), "shared")
    bits = sieve_of(shared.select(F.expr(f"fp % {SIEVE_BITS}").alias("bit")))
    parts = spread(docs.select("text")).mapInArrow(_chunks(spark.sparkContext.broadcast(bits)), "fp long, n_bytes long, chunk int, part binary")
    unlike = parts.groupBy("fp", "n_bytes", "chunk").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    unlike = stage_table(unlike.select("fp", "n_bytes").distinct(), "unlike")
    keys = ["fp", "n_bytes"]
    if not unlike.isEmpty():
        keys = ["fp", "n_bytes", "split"]
        marks = stage_table(marks.join(unlike.withColumn("u", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("split", F.when(F.col("u"), F.col("text_sha256")).otherwise("")).drop("u"), "split")
        shared = stage_table(marks.groupBy(*keys).agg(F.count("*").alias("group_size"), best).filter("group_size > 1"), "shared")
    # rows that the sieve leaves out are alone for certain; the other ones are joined with the written table of groups
    words = bits_table(spark, bits)
    bit = F.expr(f"fp % {SIEVE_BITS}")
    marked = marks.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(words), "word", "left")
    hit = F.expr(f"coalesce(shiftright(mask, cast(fp % {SIEVE_BITS} & 63 as int)) & 1, 0) = 1")
    alone = marked.filter(~hit).select(*marks.columns, F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    several = marked.filter(hit).select(*marks.columns).join(shared, keys, "left")
    own = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    several = several.select(*marks.columns, F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), own.alias("keep_id"))
    out = alone.unionByName(several)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "n_chars", "text_hash")


def first_of_each(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they are, with one row of each group of equal texts: the one that exact_groups keeps. Of
    rows that repeat both doc_id and text one stays too.

    Rows that go are named by doc_id and the text's hash in a table that is joined through a sieve, so the texts of all others
    are not shuffled."""
    i, h = free(documents, "id_", "h_")
    groups = stage_table(exact_groups(documents).filter("group_size > 1").select("doc_id", "kept", "text_hash"), "groups")
    gone = groups.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    gone = stage_table(gone.filter("not kept or n > 1").select(i, h, F.col("kept").alias("again")), "dropped")
    marked = documents.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    return without(marked, gone, [i, h], once=True).drop(i, h)
