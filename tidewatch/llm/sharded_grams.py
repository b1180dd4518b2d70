"""Interpolated modified Kneser-Ney over n-grams of unfolded code points, with counts and probabilities in sharded tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, free, gathered, mix64, quoted, release, row_runs, spread, stage_table, utf8_buffers

#: Order of the model, in code points. Its tables have a row per gram seen and grow with the text.
ORDER = 6
#: Code points there are; a symbol never seen has this share of the weight of all unseen ones.
SYMBOLS = 0x110000
#: Rows of the tables that each worker also holds: the most frequent ones, whose many occurrences need no shuffle then.
#: It changes where a gram is looked up, never what is found; all other grams are joined by key.
CACHE_ROWS = 1 << 20
#: Bytes of text scored or counted at once, and grams whose results a worker keeps; both bound its memory.
SCORED_BYTES = 1 << 18
KEPT_GRAMS = 1 << 20
#: Binary logarithm of the bits of the sieve that says of a gram that the model has no row of it (8 MiB, whatever the input). When
#: it fills up, more grams are looked up by key, and nothing else changes.
SIEVE_LOG = 26
_FIRST_BITS = 20
#: U+0000 is counted as this noncharacter, since numpy strings end at it.
_NUL = 0x10FFFF
_FACTORS = mix64(np.arange(1, ORDER + 1)) | np.uint64(1)


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the rows, each preceded by ORDER - 1 line ends, and the n + 1 offsets of the rows without those."""
    raw = data[bounds[0] : bounds[-1]]
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][bounds - bounds[0]]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        points, starts = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(r) for r in rows])]
    padded = np.full(len(points) + (len(bounds) - 1) * (ORDER - 1), 10, np.uint32)
    padded[np.arange(len(points)) + np.repeat(np.arange(1, len(bounds)) * (ORDER - 1), np.diff(starts))] = np.where(points == 0, _NUL, points)
    return padded, starts


def _ends(starts: np.ndarray) -> np.ndarray:
    """Where each symbol of the rows stands among the padded ones."""
    return np.arange(starts[-1]) + np.repeat(np.arange(1, len(starts)) * (ORDER - 1), np.diff(starts))


def _keys(windows: np.ndarray) -> np.ndarray:
    """64-bit keys of the grams that are the rows of a matrix of code points."""
    k = windows.shape[1]
    key = np.full(len(windows), k, np.uint64)
    for j in range(k):
        key += windows[:, j].astype(np.uint64) * _FACTORS[j]
    return mix64(key)


def _distinct(padded: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys (sorted) of the distinct grams that end at these places, a place of each, and which of them each place has."""
    if not len(ends):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(padded) - ORDER + 1
    rolling = np.zeros(n, np.uint64)
    for j in range(ORDER):
        rolling += padded[j : j + n] * _FACTORS[j]
    key = mix64(rolling[ends - ORDER + 1])
    # places are packed into the low bits, so that one plain sort gives both; should two keys differ in those bits only, an
    # indirect sort decides
    low = np.uint64((1 << len(key).bit_length()) - 1)
    packed = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    sorted_ = key[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    if (new[1:] & ((packed[1:] & ~low) == (packed[:-1] & ~low))).any():
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return sorted_[new], ends[order[new]], which


def _windows(padded: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return padded[ends[:, None] + np.arange(1 - ORDER, 1)]


def _strings(windows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(windows).view(f"<U{windows.shape[1]}").ravel(), pa.string())


def counted(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct grams of the rows and their counts in rows whose part is 0 and 1. SCORED_BYTES of text are counted at once (a
    longer row at once too), and the counts added up by key."""
    found = []
    for low, high in row_runs(bounds, SCORED_BYTES):
        padded, starts = code_points(data, bounds[low : high + 1])
        keys, at, which = _distinct(padded, _ends(starts))
        n = np.bincount(which, minlength=len(at))
        one = np.bincount(which, np.repeat(parts[low:high], np.diff(starts)), len(at)).astype(np.int64)
        found.append((keys, _windows(padded, at), n - one, one))
    keys, windows, zero, one = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) == 1 or not len(keys):
        return _strings(windows), zero, one
    found.clear()
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return _strings(windows[order[first]]), np.add.reduceat(zero[order], first), np.add.reduceat(one[order], first)


def count_grams(texts: DataFrame, part: Column | None = None) -> DataFrame:
    """gram, n0, n1 of the ORDER-grams of all rows (column text): counts in rows whose part is 0 (default: all) and 1. They are added
    up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(0))
            parts = batch.column(1).to_numpy()
            for low, high in row_runs(bounds):
                grams, zero, one = counted(data, bounds[low : high + 1], parts[low:high])
                yield pa.RecordBatch.from_arrays([grams, pa.array(zero, pa.int64()), pa.array(one, pa.int64())], names=["gram", "n0", "n1"])
        release()

    rows = texts.select("text", (F.lit(0) if part is None else part).cast("int").alias("part"))
    return spread(rows).mapInArrow(run, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class GramModel:
    table: DataFrame  # gram, delta, backoff of the grams of all orders
    base: float  # log probability of a symbol never seen, without context
    cache: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted keys, delta and backoff of the most frequent rows
    known: np.ndarray  # sieve of the keys of all rows


def _string_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of grams of any orders, given as strings."""
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    keys = np.empty(len(grams), np.uint64)
    for k in np.unique(lengths).tolist():
        of = lengths == k
        keys[of] = _keys(grams[of].astype(f"<U{k}").view(np.uint32).reshape(-1, k))
    return keys


def _cache(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CACHE_ROWS rows of the table or a few less: those that occur most often (f), and of the last class of frequencies (by powers of two)
    a share by hash. Keys are made in tasks."""
    level = F.floor(F.log2(F.col("f") + 1))
    sizes = {r["level"]: r["k"] for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}
    least, room = max(sizes, default=0) + 1, CACHE_ROWS
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    share = F.lit(False) if least <= 0 else (level == least - 1) & (F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < int((1 << 20) * 0.98 * room / sizes[least - 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _string_keys(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1), batch.column(2)], names=["key", "delta", "backoff"])

    rows = gathered(table.filter((level >= least) | share).select("gram", "delta", "backoff").mapInArrow(run, "key long, delta double, backoff double"))
    keys = rows.pop("key").astype(np.int64, copy=False).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.pop("delta").astype(float, copy=False)[order], rows.pop("backoff").astype(float, copy=False)[order]


def _sieve_bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - SIEVE_LOG)
    return ((keys >> shift).astype(np.int64), ((keys * _FACTORS[0]) >> shift).astype(np.int64))


def _known(table: DataFrame) -> np.ndarray:
    """A sieve of the keys of all rows, two bits each; the driver receives 2 ** SIEVE_LOG / 64 words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.concatenate(_sieve_bits(_string_keys(batch.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["word", "mask"])

    words = gathered(table.select("gram").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")))
    sieve = np.zeros(1 << SIEVE_LOG - 6, np.int64)
    sieve[words["word"].astype(np.int64)] = words["mask"]
    return sieve


def fit_grams(counts: DataFrame, discounts) -> GramModel:
    """The model of counted ORDER-grams. Lower orders count the distinct symbols that precede.

    For each order, from 1 up, the totals of its contexts come from a window over each context, which has as many rows as there
    are symbols at most, and the next lower order from a join by suffix. delta is what a gram's log probability is above that of
    its suffix with the weight of the context, backoff is the log weight of a gram as a context. So the log probability of a
    symbol is base, plus delta of the grams of all orders that end there, plus backoff of their contexts, where grams never seen
    add nothing. counts (gram, n) is read several times: a staged table. Tables that only lead to the model are deleted."""
    tables = {ORDER: counts.select("gram", "n", F.col("n").alias("f"))}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = stage_table(tables[order + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"), F.sum("f").alias("f")), f"order-{order}")
    few = None
    for order, table in tables.items():
        some = table.filter("n <= 4").groupBy(F.lit(order).alias("order"), "n").agg(F.count("*").alias("k"))
        few = some if few is None else few.unionByName(some)
    found: dict[int, dict[int, int]] = {order: {} for order in tables}
    for r in few.collect():
        found[r["order"]][r["n"]] = r["k"]
    staged, base, lower = {}, float(-np.log(SYMBOLS)), None
    for order in range(1, ORDER + 1):
        d1, d2, d3 = discounts(found[order])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        table = tables[order].withColumns({"context": F.expr(f"left(gram, {order - 1})"), "suffix": F.expr("substring(gram, 2)"), "discount": discount})
        inside = Window.partitionBy("context")
        table = table.withColumns({"total": F.sum("n").over(inside), "weight": F.sum("discount").over(inside), "often": F.sum("f").over(inside), "first": F.row_number().over(inside.orderBy("gram")) == 1})
        table = table.withColumn("weight", F.col("weight") / F.col("total"))
        table = table.withColumn("lower", F.lit(1.0 / SYMBOLS)) if lower is None else table.join(lower, "suffix")
        p = (F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * F.col("lower")
        staged[order] = stage_table(table.select("gram", "f", "often", "first", "weight", p.alias("p"), F.log(p / (F.col("weight") * F.col("lower"))).alias("delta")), f"grams-{order}")
        lower = staged[order].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        if order < ORDER:
            drop_table(tables[order])
    first = staged[1].first()
    if first:
        base += float(np.log(first["weight"]))
    rows = None
    for order, table in staged.items():
        own = table.select("gram", "delta", F.lit(0.0).alias("backoff"), "f")
        if order > 1:
            contexts = table.filter("first").select(F.expr(f"left(gram, {order - 1})").alias("gram"), F.lit(0.0).alias("delta"), F.log("weight").alias("backoff"), F.col("often").alias("f"))
            own = own.unionByName(contexts)
        rows = own if rows is None else rows.unionByName(own)
    table = stage_table(rows.groupBy("gram").agg(F.sum("delta").alias("delta"), F.sum("backoff").alias("backoff"), F.max("f").alias("f")), "model")
    for order in staged:
        drop_table(staged[order])
    return GramModel(table.select("gram", "delta", "backoff"), base, _cache(table), _known(table))


class _Resolver:
    """Log probabilities of grams from what a worker holds: the cache, the sieve and the results of grams met before."""

    #: Parts of a gram's log probability: the last k symbols as a gram, and those before the last as its context.
    PARTS = [(k, True) for k in range(1, ORDER + 1)] + [(k, False) for k in range(1, ORDER)]

    def __init__(self, cache: tuple[np.ndarray, np.ndarray, np.ndarray], known: np.ndarray, base: float) -> None:
        self.cache, self.known, self.base = cache, known, base
        # keys are hashes: their first bits say where to look, a few places each
        self.starts = np.searchsorted(cache[0], np.arange(1 << _FIRST_BITS, dtype=np.uint64) << np.uint64(64 - _FIRST_BITS)).astype(np.int32)
        self.starts = np.r_[self.starts, np.int32(len(cache[0]))]
        self.keys, self.logp, self.open = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int32)

    @staticmethod
    def part(windows: np.ndarray, k: int, ends: bool) -> np.ndarray:
        return windows[:, ORDER - k :] if ends else windows[:, ORDER - 1 - k : ORDER - 1]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where keys stand in the cache; -1 where they do not."""
        out, first = np.full(len(keys), -1), (keys >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)
        end, at = self.starts[first + 1], self.starts[first]
        alive = np.flatnonzero(at < end)
        at = at[alive]
        while len(alive):
            same = self.cache[0][at] == keys[alive]
            out[alive[same]] = at[same]
            alive, at = alive[~same], at[~same] + 1
            more = at < end[alive]
            alive, at = alive[more], at[more]
        return out

    def _look_up(self, windows: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """What the cache has for grams, else 0, and where it has nothing and the sieve does not rule out a row of the model."""
        keys = _keys(windows)
        out, maybe, at = np.zeros(len(keys)), np.zeros(len(keys), bool), self._places(keys)
        hit = at >= 0
        out[hit] = self.cache[column][at[hit]]
        miss = np.flatnonzero(~hit)
        one, two = _sieve_bits(keys[miss])
        maybe[miss] = (self.known[one >> 6] >> (one & 63) & self.known[two >> 6] >> (two & 63) & 1).astype(bool)
        return out, maybe

    def resolve(self, keys: np.ndarray, padded: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct grams (sorted keys, and a place of each) the log probability without the parts that are open, and a bit for
        each part (in the order of PARTS) that the sharded table must be asked for."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        logp, left = np.full(len(keys), self.base), np.zeros(len(keys), np.int32)
        if len(self.keys):
            logp[seen], left[seen] = self.logp[at[seen]], self.open[at[seen]]
        new = np.flatnonzero(~seen)
        windows = _windows(padded, ends[new])
        sums, bits = np.full(len(new), self.base), np.zeros(len(new), np.int32)
        for j, (k, whole) in enumerate(self.PARTS):
            value, maybe = self._look_up(self.part(windows, k, whole), 1 if whole else 2)
            sums += value
            bits |= maybe.astype(np.int32) << j
        logp[new], left[new] = sums, bits
        if len(self.keys) + len(new) > KEPT_GRAMS:
            keep = min(len(keys), KEPT_GRAMS // 2)
            self.keys, self.logp, self.open = keys[:keep], logp[:keep], left[:keep]
        elif len(new):
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.logp, self.open = (np.insert(x, where, y) for x, y in ((self.keys, keys[new]), (self.logp, sums), (self.open, bits)))
        return logp, left


def score_grams(documents: DataFrame, model: GramModel, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_symbols and nll, the sum of negative log probabilities of the whole text (null: 0 and 0).

    A task adds up the parts that it can resolve from what workers hold, and returns the other ones of each document, counted:
    these are joined by key with the sharded model and added to their documents. `keep` must not name n_symbols or nll; texts
    are sent one way only and are not shuffled, so keep ids or hashes, not texts."""
    shared, base = documents.sparkSession.sparkContext.broadcast((model.cache, model.known)), model.base
    text, row, other, more = free(documents, "text_", "row_", "rest_", "more_")
    rows = documents.select(*(quoted(c) for c in keep), F.col("text").alias(text))
    fields = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*fields, "n_symbols long", "nll double", f"{row} long", f"{other} array<struct<gram:string,whole:boolean,n:long>>"])
    names = [*keep, "n_symbols", "nll", row, other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        resolver = _Resolver(*shared.value, base)
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(batch.num_columns - 1))
            for low, high in row_runs(bounds, SCORED_BYTES):
                padded, starts = code_points(data, bounds[low : high + 1])
                size, count = np.diff(starts), high - low
                keys, ends, which = _distinct(padded, _ends(starts))
                logp, left = resolver.resolve(keys, padded, ends)
                nll = np.diff(np.r_[0.0, np.cumsum(-logp[which])][starts])
                at = np.flatnonzero(left[which])
                pair, n = np.unique((np.searchsorted(starts, at, "right") - 1).astype(np.int64) * (len(keys) + 1) + which[at], return_counts=True)
                of, gram = pair // (len(keys) + 1), pair % (len(keys) + 1)
                windows, found = _windows(padded, ends[gram]), []
                for j, (k, whole) in enumerate(_Resolver.PARTS):
                    mine = np.flatnonzero(left[gram] >> j & 1)
                    found.append((of[mine], _strings(_Resolver.part(windows[mine], k, whole)), np.full(len(mine), whole), n[mine]))
                of = np.concatenate([x[0] for x in found])
                order = np.argsort(of, kind="stable")
                structs = [pa.concat_arrays([x[1] for x in found]).take(pa.array(order)), pa.array(np.concatenate([x[2] for x in found])[order]), pa.array(np.concatenate([x[3] for x in found])[order], pa.int64())]
                offsets = np.searchsorted(of[order], np.arange(count + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(structs, names=["gram", "whole", "n"]))
                values = [pa.array(size.astype(np.int64)), pa.array(nll), pa.array(number + np.arange(count)), rest]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, count).columns[:-1], *values], names=names)
                number += count
        del resolver
        release(shared)

    scored = stage_table(spread(rows).mapInArrow(run, schema), "scored")
    shared.destroy()
    rest = scored.filter(f"size({other}) > 0").select(row, F.explode(other).alias("x")).select(row, "x.gram", "x.whole", "x.n")
    part = F.when(F.col("whole"), F.col("delta")).otherwise(F.col("backoff"))
    added = rest.join(model.table, "gram").groupBy(row).agg(F.sum(F.col("n") * part).alias(more))
    joined = scored.drop(other).join(added, row, "left")
    return joined.withColumn("nll", F.col("nll") - F.coalesce(more, F.lit(0.0))).drop(row, more)
