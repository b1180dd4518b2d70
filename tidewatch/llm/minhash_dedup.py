"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, id_bit, mix64, row_runs, sieve_words, sieved, spread, stage_table, utf8_buffers, without
from .components import components

WORDS = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared in one step, and the posterior probability of a link below which a pair is dropped.
BATCH = 16
MISS = 1e-7
#: Members of a bucket that one task compares with each other; larger buckets are cut into pairs of blocks.
BLOCK = 512
#: Bytes of shingle sets that a block holds on average: buckets of long texts are cut into more blocks.
BLOCK_BYTES = 1 << 23

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_STEPS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_A = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
_B = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the rows in order, and the n + 1 offsets of the rows among them.

    Words are runs of other bytes than blanks (0x20, 0x09 to 0x0D), with A to Z in lower case."""
    own = data[bounds[0] : bounds[-1]]
    own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
    bounds = bounds - bounds[0]
    solid = ~((own == 32) | ((own >= 9) & (own <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = bounds[:-1][bounds[:-1] < len(own)]
    first[cut] = solid[cut]
    offsets = np.searchsorted(np.flatnonzero(first), bounds)
    breaks = np.flatnonzero(first[solid])
    if not len(breaks):
        return np.empty(0, np.uint64), offsets
    letters = own[solid]
    sizes = np.diff(np.r_[breaks, len(letters)])
    place = np.arange(len(letters)) - np.repeat(breaks, sizes)
    values = _BYTES[letters] * _PLACES[place & 63]
    if sizes.max() > 64:  # long words: the place within each 64 bytes, mixed with the number of those before
        far = place > 63
        values[far] = mix64(values[far] + (place[far] >> 6).astype(np.uint64) * _ODD)
    return mix64(np.add.reduceat(values, breaks) + sizes.astype(np.uint64)), offsets


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its shingles of WORDS words, or of the whole sequence if it has fewer."""
    words, offsets = word_hashes(data, bounds)
    n = len(words)
    grams = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        grams += words[j : j + len(grams)] * _STEPS[j]
    grams = mix64(grams)
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if high - low >= WORDS:
            out.append(_distinct(grams[low : high - WORDS + 1]))
        elif high > low:
            short = np.uint64(high - low) + (words[low:high] * _STEPS[: high - low]).sum(dtype=np.uint64)
            out.append(mix64(np.array([short ^ _ODD])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, a row each."""
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    flat = np.concatenate(sets)
    mixed, least = np.empty_like(flat), np.empty((HASHES, len(sets)), np.uint64)
    for k in range(HASHES):
        np.multiply(flat, _A[k], out=mixed)
        np.add(mixed, _B[k], out=mixed)
        np.minimum.reduceat(mixed, starts, out=least[k])
    return np.ascontiguousarray((least >> np.uint64(32)).astype(np.uint32).T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD + np.zeros((len(parts), 1), np.uint64)
    for j in range(ROWS):
        keys = mix64(keys + parts[:, :, j] * _STEPS[j])
    return keys.astype(np.int64)


_SKETCH = "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8_buffers(batch.column(1))
        for low, high in row_runs(bounds):
            sets = shingle_sets(data, bounds[low : high + 1])
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, packed, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                made = signatures([sets[i] for i in full])
                for i, row, own in zip(full, made.astype(np.uint16), band_keys(made).tolist(), strict=True):
                    digest[i], packed[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes(), own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature", "keys"])


@lru_cache
def least_matches(similarity: int = SIMILARITY, miss: float = MISS) -> tuple[int, ...]:
    """After 1, 2, ... batches, the fewest matching values with which a pair stays a candidate.

    With a uniform prior the similarity's posterior after m matches in n is Beta(m + 1, n - m + 1); a pair is dropped
    when its probability of reaching the threshold is below miss."""
    t, out = similarity / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = lambda m: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731  P(Beta(m+1, n-m+1) >= t)
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def compare(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (rows of left and right), the numbers of those that stay after all batches, and their matching
    values; later batches look at survivors only."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def plausible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros(len(left), bool)
    out[compare(left, right)[0]] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 8192):
            part = batch.slice(low, 8192)
            yield part.filter(pa.array(plausible(_matrix(part.column(2)), _matrix(part.column(3))))).select([0, 1])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8_buffers(batch.column(1))
        for low, high in row_runs(bounds):
            sets = shingle_sets(data, bounds[low : high + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])


def shingles_of(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, shingles of the documents in ends (doc_id, distinct), made anew from their texts: a sieve of fixed size keeps most
    other texts from being shuffled."""
    some = sieved(spread(docs), "doc_id", sieve_words(ends.select(id_bit("doc_id"))))
    return stage_table(some.join(ends, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    sets = shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return with_b.mapInArrow(_verify, "a long, b long")


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (numbers of sets) are similar enough, exactly. Many pairs of few sets are counted together, as a
    product of their incidence matrix with itself, some thousand shingles at a time."""
    sizes = np.array([len(s) for s in sets])
    if len(a) < 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times > 1
        rank = np.cumsum(several) - 1
        keep = several[column]
        owner, column = owner[keep], rank[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        product = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(several.sum()), 4096):
            part = slice(*np.searchsorted(column, (low, low + 4096)))
            incidence = np.zeros((len(sets), 4096), np.float32)
            incidence[owner[part], column[part] - low] = 1
            product += incidence @ incidence.T
        both = product[a, b].astype(np.int64)
    return 100 * both >= SIMILARITY * (sizes[a] + sizes[b] - both)


def cell_links(ids: np.ndarray, parts: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components (parts) in a cell: within it, or between its two sides.

    Pairs that survive the batches are confirmed on full sets, likely ones first; only those that join two components not yet
    joined here are returned, so there are fewer links than members."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side) if side.any() else left
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(left), max(1, 65536 // max(1, len(right)))):
        rows = left[low : low + max(1, 65536 // max(1, len(right)))]
        a, b = np.repeat(rows, len(right)), np.tile(right, len(rows))
        keep = (parts[a] != parts[b]) & ((a < b) | bool(side.any()))
        a, b = a[keep], b[keep]
        alive, matches = compare(marks[a], marks[b])
        found.append((a[alive], b[alive], matches))
    a, b, matches = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
    if not len(a):
        return []
    used, numbers = np.unique(np.r_[a, b], return_inverse=True)
    good = _similar([sets[u] for u in used], numbers[: len(a)], numbers[len(a) :])
    a, b, matches = a[good], b[good], matches[good]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for k in np.argsort(-matches, kind="stable"):
        x, y = find(int(parts[a[k]])), find(int(parts[b[k]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(tuple(sorted((int(ids[a[k]]), int(ids[b[k]])))))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all cells; rows arrive sorted by cell (key, i, j), and one cell is held at a time."""
    held: list[pa.RecordBatch] = []

    def links() -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held)
        ids, parts, side = (rows.column(k).to_numpy() for k in (4, 5, 3))
        marks = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint16).reshape(-1, HASHES)
        return cell_links(ids, parts, marks, [np.frombuffer(x, np.uint64) for x in rows.column(7).to_pylist()], side)

    out: list[tuple[int, int]] = []
    last = None
    for batch in batches:
        cells = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        edges = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1, len(cells)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if low == high:
                continue
            now = tuple(cells[low].tolist())
            if held and now != last:
                out += links()
                held = []
            last = now
            held.append(batch.slice(low, high - low))
    if held:
        out += links()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of distinct shingles is 0.75 or more; a text of fewer
    words than a shingle has them all as its only shingle; null or blank texts have none and stay alone. component_id is the
    smallest doc_id reached over links.

    1. Documents with the same set are one class; only its smallest doc_id goes on.
    2. Every member of a band's bucket is compared with the bucket's smallest member: rows grow with the members, not with
       their pairs. Pairs that survive the signature batches are confirmed on full sets.
    3. Buckets whose members are then in several components are compared member by member, between components only, in
       cells of two blocks of BLOCK members (fewer if their sets pass BLOCK_BYTES), which hold the members' sets; a cell emits
       fewer links than it has members.
    4. Components are contracted in tables of the shared folder.

    Rows without doc_id are left out; rows that repeat a doc_id have the component of that id. Columns other than
    doc_id and text are ignored; an empty table gives an empty result."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sketches = stage_table(spread(docs).mapInArrow(_sketch, _SKETCH), "sketches")
    classes = sketches.filter("digest is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = stage_table(sketches.select("doc_id", "n_shingles", "digest").join(classes, ["digest", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = stage_table(sketches.filter("digest is not null").join(member.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "signature", "keys"), "representatives")
    banded = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    buckets = stage_table(banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stage_table(banded.join(buckets, "key"), "members")
    side = lambda a: reps.select(F.col("doc_id").alias(a), F.col("signature").alias(f"s{a}"))
    stars = members.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(_prune, "a long, b long")
    links = stage_table(confirmed(stage_table(stars, "stars"), docs), "links")
    joined = stage_table(components(links), "components")

    several = members.filter("n > 2").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "n", "n_shingles", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = stage_table(several, "several")
    outside = several.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("total")).filter("low <> high")
    outside = stage_table(outside.select(F.col("key").alias("outer"), "total"), "outside")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("total") / BLOCK_BYTES)).cast("int")
    rest = several.join(outside, F.col("key") == F.col("outer")).select("key", "doc_id", "component", blocks.alias("blocks")).join(reps.select("doc_id", "signature"), "doc_id")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = stage_table(rest.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "component", "signature"), "rest")
    cells = rest.join(shingles_of(rest.select("doc_id").distinct(), docs), "doc_id").select("key", "i", "j", "side", "doc_id", "component", "signature", "shingles")
    more = stage_table(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cells, "a long, b long").distinct(), "more")
    if not more.isEmpty():
        joined = stage_table(components(links.unionByName(more)), "components")
    out = member.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def first_of_each(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they are, with one document of each group of near duplicates: the smallest doc_id.

    Rows without doc_id cannot be linked and stay; rows that repeat a doc_id stay or go together. The ids that go are joined
    through a sieve, so the texts of all others are not shuffled."""
    (i,) = free(documents, "id_")
    gone = stage_table(near_groups(documents).filter("not kept").select(F.col("doc_id").alias(i)).distinct(), "dropped")
    return without(documents.withColumn(i, F.col("doc_id").cast("long")), gone, [i]).drop(i)
