"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm over islands."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_ids import text_ids
from .common import gathered, row_runs, spread, stage_table, utf8_buffers

#: A bin type is a tuple of lengths in descending order; a solution counts how many sequences of each type there are.
Bins = Counter
#: Cells over which the pieces of one length are numbered.
CELLS = 64
#: Islands, most rounds of evolution (a migration after each), children an island has in a round, and solutions on an island.
ISLANDS = 6
ROUNDS = 8
GENERATIONS = 6
POPULATION = 4
#: Rounds without a better solution on any island after which evolution ends.
PATIENCE = 3


def _put(bins: Bins, demand: dict[int, int], capacity: int) -> None:
    """Best fit, longest pieces first, many equal pieces at once: those of one length go to the fullest bins that hold them,
    and open new bins only when none does."""
    room: dict[int, Counter] = {}
    for kind, n in bins.items():
        room.setdefault(capacity - sum(kind), Counter())[kind] += n
    bins.clear()
    for length in sorted(demand, reverse=True):
        left = demand[length]
        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            fit = space // length  # a bin takes as many as go in, so later bins stay whole
            for kind in sorted(room[space], reverse=True):
                if not left:
                    break
                n = room[space][kind]
                each = min(fit, left)
                full = min(n, left // each)
                room[space][kind] -= full
                room.setdefault(space - each * length, Counter())[tuple(sorted((*kind, *[length] * each), reverse=True))] += full
                left -= full * each
            room[space] = +room[space]
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                room.setdefault(capacity - each * length, Counter())[(length,) * each] += full
            if rest:
                room.setdefault(capacity - rest * length, Counter())[(length,) * rest] += 1
    for kinds in room.values():
        bins.update(+kinds)


def best_fit(demand: dict[int, int], capacity: int) -> Bins:
    bins: Bins = Counter()
    _put(bins, demand, capacity)
    return bins


def _demand(bins: Bins) -> Counter:
    out: Counter = Counter()
    for kind, n in bins.items():
        for length in kind:
            out[length] += n
    return out


def crossover(first: Bins, second: Bins, demand: dict[int, int], capacity: int, share: float, rng: np.random.Generator) -> Bins:
    """Whole bins of the second parent, the best filled first, are injected into the first. Bins of the first that hold a
    piece which is then there twice are removed, and what they held besides is put back by best fit."""
    left, child = Counter(demand), Counter()

    def take(bins: Bins, order: list[tuple]) -> None:
        for kind in order:
            need = Counter(kind)
            n = min(bins[kind], *(left[length] // k for length, k in need.items()))
            if n > 0:
                child[kind] += n
                for length, k in need.items():
                    left[length] -= n * k

    full = sorted(second, key=lambda kind: (capacity - sum(kind), len(kind), rng.random()))
    take(second, full[: max(1, int(len(full) * share))])
    own = list(first)
    rng.shuffle(own)
    take(first, sorted((tuple(map(int, k)) for k in own), key=lambda kind: capacity - sum(kind)))
    _put(child, +left, capacity)
    return child


def fullest(space: int, lengths: list[int], left: Counter) -> list[int]:
    """Pieces of the given lengths (descending) whose sum comes closest to `space` from below, longer ones preferred.

    The sums that can be reached are the bits of one number; a piece shifts them by its length."""
    reach, steps, mask = 1, [], (1 << space + 1) - 1
    for length in lengths:
        room, size = min(left[length], space // length), 1
        while room > 0:
            take = min(size, room)
            after = reach | reach << take * length & mask
            if after != reach:
                steps.append((reach, length, take))
                reach = after
            if reach >> space:
                break
            room, size = room - take, size * 2
        if reach >> space:
            break
    at, out = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def fill(bins: Bins, left: Counter, capacity: int, rng: np.random.Generator, share: float) -> None:
    """Puts pieces back longest first, each with the others that fill its sequence best, among a random share of the lengths; the
    same kind of sequence as many times as there are pieces for it. So each length is used up after a few kinds."""
    for length in sorted(left, reverse=True):
        while left[length]:
            left[length] -= 1
            some = [x for x in sorted(left, reverse=True) if x <= capacity - length and left[x] and (share >= 1 or rng.random() < share)]
            kind = tuple(sorted((length, *fullest(capacity - length, some, left)), reverse=True))
            left[length] += 1
            need = Counter(kind)
            n = min(left[x] // k for x, k in need.items())
            bins[kind] += n
            for x, k in need.items():
                left[x] -= n * k


def mutate(bins: Bins, demand: dict[int, int], capacity: int, rng: np.random.Generator) -> Bins:
    """Takes apart all sequences that are not full and some of the others, and fills anew."""
    kept: Bins = Counter()
    away = rng.uniform(0.02, 0.4)
    for kind, n in bins.items():
        if sum(kind) == capacity and (stay := n - int(rng.binomial(n, away))):
            kept[kind] = stay
    left = Counter(demand)
    left.subtract(_demand(kept))
    fill(kept, +left, capacity, rng, rng.choice((1.0, 0.9, 0.6)))
    return kept


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; then fuller ones, by the mean square of the fill."""
    return bins.total(), -sum(n * (sum(kind) / capacity) ** 2 for kind, n in bins.items())


def least_bins(demand: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a sequence need one each, and those from a length on that fit beside none of the long ones
    need room of their own (for every such length); all tokens together need theirs."""
    out = -(-sum(length * n for length, n in demand.items()) // capacity)
    for a in {0, *(x for x in demand if 2 * x <= capacity)}:
        long = sum(n for x, n in demand.items() if x > capacity - a)
        half = [(x, n) for x, n in demand.items() if capacity < 2 * x and x <= capacity - a]
        short = sum(x * n for x, n in demand.items() if a <= x and 2 * x <= capacity)
        room = sum((capacity - x) * n for x, n in half)
        out = max(out, long + sum(n for _, n in half) + max(0, -(-(short - room) // capacity)))
    return out


def evolve(population: list[Bins], demand: dict[int, int], capacity: int, generations: int, seed: int, least: int = 0) -> list[Bins]:
    """The population after some children: each comes from two parents, is changed, and takes the place of the worst solution if it
    is better. It ends early with a solution of `least` sequences."""
    rng = np.random.default_rng(seed)
    rank = lambda b: fitness(b, capacity)
    population = list(population) or [best_fit(demand, capacity)]
    while len(population) < POPULATION and min(b.total() for b in population) > least:
        population.append(mutate(population[0], demand, capacity, rng))
    for _ in range(generations):
        population.sort(key=rank)
        if population[0].total() <= least:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        child = crossover(population[i], population[j], demand, capacity, rng.uniform(0.2, 0.8), rng)
        child = min(child, mutate(child, demand, capacity, rng), mutate(population[i], demand, capacity, rng), key=rank)
        if rank(child) < rank(population[-1]) and child not in population:
            population[-1] = child
    return sorted(population, key=rank)


def _rows(population: list[Bins], island: int) -> list[tuple]:
    return [(island, member, list(kind), int(n)) for member, bins in enumerate(population) for kind, n in bins.items() if n]


_POPULATION = "island int, member int, kind array<int>, n long"


def plan_bins(spark, demand: dict[int, int], capacity: int, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS) -> Bins:
    """Bin types for a histogram of lengths: islands evolve as Spark tasks and keep their populations; after each round the elite of
    each also comes to the next island of a ring, in place of the worst there. Evolution ends at the lower bound, after PATIENCE
    rounds without gain, or after `rounds`. The histogram has `capacity` entries at most and a solution a few kinds of sequence a
    length, so nothing here grows with the number of pieces."""
    if not demand:
        return Counter()
    least = least_bins(demand, capacity)
    best = best_fit(demand, capacity)
    homes: dict[int, list[Bins]] = {i: [best] for i in range(islands)}
    idle = 0
    for step in range(rounds):
        if best.total() <= least or idle >= PATIENCE:
            break
        sent = spark.sparkContext.broadcast((demand, homes))

        def run(batches: Iterator[pd.DataFrame], sent=sent, step=step) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for island in batch["id"]:
                    need, population = sent.value
                    found = evolve(population[island], need, capacity, generations, 7919 * step + int(island), least)
                    yield pd.DataFrame(_rows(found, int(island)), columns=["island", "member", "kind", "n"])

        rows = spark.range(0, islands, 1, islands).mapInPandas(run, _POPULATION).collect()
        sent.unpersist()
        members: dict[tuple[int, int], Bins] = {}
        for r in rows:
            members.setdefault((r["island"], r["member"]), Counter())[tuple(r["kind"])] = r["n"]
        for i in range(islands):
            homes[i] = [members[k] for k in sorted(members) if k[0] == i]
        elites = [homes[i][0] for i in range(islands)]
        for i in range(islands):
            if elites[i - 1] not in homes[i]:
                homes[i] = [*homes[i][:-1], elites[i - 1]] if len(homes[i]) >= POPULATION else [*homes[i], elites[i - 1]]
        now = min(elites, key=lambda b: fitness(b, capacity))
        idle = 0 if now.total() < best.total() else idle + 1
        best = min(best, now, key=lambda b: fitness(b, capacity))
    return best


@dataclass
class Places:
    """Where the pieces of each length go: for a piece number, the last start at or before it gives sequence and offset."""

    starts: dict[int, np.ndarray]
    first: dict[int, np.ndarray]  # sequence of the piece at the start; the next piece goes to the next sequence
    offset: dict[int, np.ndarray]


def places(bins: Bins) -> Places:
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for kind, n in sorted(bins.items(), reverse=True):
        at = 0
        for length in kind:
            rows.setdefault(length, []).append((taken[length], sequence, at))
            taken[length] += n
            at += length
        sequence += n
    column = lambda k: {length: np.array([r[k] for r in x], np.int64) for length, x in rows.items()}
    return Places(column(0), column(1), column(2))


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of all documents: the ids of the whole text and the end id, cut only if longer than capacity, from the end,
    so that only the first piece is shorter. Null text counts as empty and gives a piece of the end id alone. Rows that repeat a
    doc_id, or have none, give pieces of their own; columns other than doc_id and text are ignored. A task holds the ids of
    a few rows at a time, and of one text whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, bounds = utf8_buffers(batch.column(1))
            for low, high in row_runs(bounds, 1 << 20):
                part, rows = batch.slice(low, high - low), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    size = n if n <= capacity else n % capacity or capacity
                    while start < n:
                        rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                        start, piece, size = start + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays(list(map(pa.array, list(zip(*rows, strict=True)) or [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()])), names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECES)


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id and offset of every piece (columns of PIECES; an empty table gives an empty result; other columns are ignored).

    Pieces of one length are interchangeable: their counts alone make the plan, and the k-th piece of a length takes the
    k-th place of that length. They are numbered over cells (length and a hash of the row), whose counts number
    capacity * CELLS at most, so no task holds all pieces of a frequent length. Workers receive these counts (512 KiB for 1024
    tokens) and the places of each length, as many as there are kinds of sequence in the plan. Rows that repeat a document's piece
    each get a place of their own."""
    spark = found.sparkSession
    names = [c.split()[0] for c in PIECES.split(", ")]
    rows = found.select(*names).withColumn("part", F.monotonically_increasing_id())
    found = stage_table(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "part"), F.lit(CELLS)).cast("int")), "pieces")
    counts = gathered(found.groupBy("length", "cell").count())
    table = np.zeros((capacity + 1, CELLS), np.int64)
    table[counts["length"].astype(int), counts["cell"].astype(int)] = counts["count"]
    demand = {int(k): int(n) for k, n in enumerate(table.sum(axis=1)) if n}
    bases = np.cumsum(table, axis=1) - table
    shared = spark.sparkContext.broadcast((places(plan_bins(spark, demand, capacity)), bases))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, cell: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        at, base = shared.value
        lengths = length.to_numpy()
        numbers = number.to_numpy(np.int64) + base[lengths, cell.to_numpy()]
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(part):
                size = int(lengths[part[0]])
                k = np.searchsorted(at.starts[size], numbers[part], "right") - 1
                sequence[part] = at.first[size][k] + numbers[part] - at.starts[size][k]
                offset[part] = at.offset[size][k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "part")
    numbered = found.withColumn("number", F.row_number().over(order) - 1).withColumn("place", placed("length", "cell", "number"))
    return numbered.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "place.sequence_id", "place.offset")
