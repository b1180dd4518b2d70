"""Exact top-k inner-product search with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Bytes of vectors in a block of candidates or queries; a cell of the grid holds one block of each.
BLOCK_BYTES = 1 << 24
#: Candidates in a block at most while there are fewer cells than this many a core.
FEW, CELLS_A_CORE = 2048, 2
#: Queries and candidates bounded at once within a cell.
QUERIES, STRIPE = 512, 4096
#: Segments at each resolution, coarse to fine (as far as they divide into components).
RESOLUTIONS = (4, 16, 32)
#: Share of the product of the norms that is added to each bound against rounding.
SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per segment, mean and deviation, each times the root of the segment's length, and the norm times the root of SLACK.

    By Cauchy and Schwarz the inner product of two vectors is at most that of these features, and, with
    |q - x|^2 = |q|^2 + |x|^2 - 2 qx, their distance at least the one that follows from it."""
    n, dim = vectors.shape
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    length = np.diff(edges).astype(float)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / length
    rest = vectors - np.repeat(mean, np.diff(edges), axis=1)
    spread = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / length)
    norm = np.sqrt(SLACK * np.einsum("ij,ij->i", vectors, vectors))
    return np.concatenate([np.concatenate([mean, spread], axis=1) * np.sqrt(np.concatenate([length, length])), norm[:, None]], axis=1)


class Block:
    """Vectors with their ids and the features of all resolutions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.floats = ids, vectors, vectors.astype(np.float64)
        self.features = [segment_features(self.floats, s) for s in RESOLUTIONS]
        self.greatest = float(np.abs(self.floats).max(initial=0))


def _scores(q: Block, x: Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums stay below 2^53, else in integers."""
    small = q.greatest * x.greatest * q.vectors.shape[1] < 2**53
    out = np.empty(len(rows), np.int64)
    for low in range(0, len(rows), 65536):
        part = slice(low, low + 65536)
        if small:
            out[part] = np.einsum("ij,ij->i", q.floats[rows[part]], x.floats[cols[part]])
        else:
            out[part] = (q.vectors[rows[part]] * x.vectors[cols[part]]).sum(axis=1)
    return out


class Best:
    """The k best candidates of each query so far: scores in descending order, ties by id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None) -> None:
        self.k, self.ids, self.scores = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), _LEAST)
        self.known = np.zeros((n, k), bool)
        self.floors = np.full(n, _LEAST) if floors is None else floors.copy()

    def limits(self) -> np.ndarray:
        """What a bound must reach: the floors, rounded down to floating point."""
        return np.where(self.floors == _LEAST, -np.inf, np.nextafter(self.floors.astype(np.float64), -np.inf))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floors[rows]
        rows, ids, scores = rows[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for a, b in zip(starts, np.r_[starts[1:], len(rows)] if len(rows) else [], strict=True):
            r, b = rows[a], min(b, a + self.k)
            old = self.known[r]
            all_ids, all_scores = np.r_[self.ids[r][old], ids[a:b]], np.r_[self.scores[r][old], scores[a:b]]
            top = np.lexsort((all_ids, -all_scores))[: self.k]
            self.ids[r, : len(top)], self.scores[r, : len(top)], self.known[r, : len(top)] = all_ids[top], all_scores[top], True
            if len(top) == self.k:
                self.floors[r] = max(self.floors[r], all_scores[top[-1]])


def seed(q: Block, x: Block, k: int) -> np.ndarray:
    """A floor for each query: the k-th best score among the candidates that look best at the middle resolution (the least number
    there is, if there are fewer than k). Some k other rows score at least that, so what scores less is not among the best."""
    best = Best(len(q.ids), k)
    for a in range(0, len(q.ids), QUERIES):
        part = np.arange(a, min(a + QUERIES, len(q.ids)))
        for low in range(0, len(x.ids), STRIPE):
            bound = q.features[1][part] @ x.features[1][low : low + STRIPE].T
            bound[q.ids[part][:, None] == x.ids[None, low : low + STRIPE]] = -np.inf
            some = min(4 * k, bound.shape[1])
            cols = np.argpartition(-bound, some - 1, axis=1)[:, :some]
            rows = np.repeat(part, some)
            cols = low + cols.ravel()
            other = q.ids[rows] != x.ids[cols]
            best.add(rows[other], x.ids[cols[other]], _scores(q, x, rows[other], cols[other]))
    return np.where(best.known[:, -1], best.scores[:, -1], _LEAST)


def search_cell(q: Block, x: Block, k: int, floors: np.ndarray, counter: list[int] | None = None) -> Best:
    """For each query, its k best vectors of other ids in the cell that reach its floor; ties go to the smaller id.

    Bounds from coarse to fine segments are compared with the floor, which rises with the k-th best score in the cell; only what no
    bound rules out is scored. counter[0] is raised by the number of pairs scored."""
    best = Best(len(q.ids), k, floors)
    for a in range(0, len(q.ids), QUERIES):
        for low in range(0, len(x.ids), STRIPE):
            limit = best.limits()
            bound = q.features[0][a : a + QUERIES] @ x.features[0][low : low + STRIPE].T
            rows, cols = np.nonzero(bound >= limit[a : a + QUERIES, None])
            rows, cols = rows + a, cols + low
            for qs, xs in zip(q.features[1:], x.features[1:], strict=True):
                alive = np.concatenate([np.einsum("ij,ij->i", qs[rows[i : i + 65536]], xs[cols[i : i + 65536]]) >= limit[rows[i : i + 65536]] for i in range(0, len(rows), 65536)] or [np.empty(0, bool)])
                rows, cols = rows[alive], cols[alive]
            other = q.ids[rows] != x.ids[cols]
            rows, cols = rows[other], cols[other]
            if counter is not None:
                counter[0] += len(rows)
            best.add(rows, x.ids[cols], _scores(q, x, rows, cols))
    return best


def _blocks(cell: pd.DataFrame) -> tuple[np.ndarray, Block, Block]:
    side = cell["side"].to_numpy() == 1
    ids, data = cell["id"].to_numpy(np.int64), np.stack(cell["v"].to_numpy()).astype(np.int64)
    order = np.flatnonzero(~side)[np.argsort(ids[~side], kind="stable")]
    return side, Block(ids[side], data[side]), Block(ids[order], data[order])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: of each query id, the k greatest inner products with rows of vectors of another id.

    Both tables have id (long) and v (array of long). Ties go to the smaller id; with fewer than k candidates all are
    returned. Vectors are compared with those of the same length only. Null ids, vectors or components take no part; scores are
    exact as long as they fit a long. Every row counts: candidates that repeat an id each have their score, and queries that
    repeat one share its k places. Empty tables give an empty result; other columns are ignored.

    Rows are numbered and dealt to blocks by their number. First each block of queries meets one block of candidates, and the
    scores of those that look best there give each query a floor. Then all blocks of queries meet all blocks of candidates on a
    grid, with these floors, so that bounds rule out pairs from the start. A task holds one block of each, of BLOCK_BYTES, whatever
    the input's size; a vector is sent once for each block of the other side. Nothing is broadcast or collected."""
    good = "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)"
    numbered = lambda df, label: stage_table(df.filter(good).select("id", "v", F.monotonically_increasing_id().alias("row")), label)
    vectors, queries = numbered(vectors, "vectors"), numbered(queries, "queries")
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, m, most = sizes["n"], queries.count(), max(1, BLOCK_BYTES // (8 * (sizes["width"] or 1)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    columns, rows = max(1, -(-n // most), min(CELLS_A_CORE * cores, -(-n // FEW))), max(1, -(-m // most))
    deal = lambda size: F.pmod(F.xxhash64("row"), F.lit(size)).cast("int")
    seq = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = vectors.select("id", "v", "row", deal(columns).alias("block"), F.lit(0).alias("side"), F.lit(_LEAST).alias("floor"))
    right = queries.select("id", "v", "row", deal(rows).alias("part"), F.lit(1).alias("side"))
    parts = F.explode(F.sequence(F.col("block"), F.lit(rows - 1), F.lit(columns)))  # part p meets block p mod columns first
    first = left.filter(F.col("block") < rows).withColumn("part", parts).unionByName(right.withColumn("block", F.col("part") % columns).withColumn("floor", F.lit(_LEAST)))

    def floors(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        side, q, x = _blocks(cell)
        found = seed(q, x, k) if len(q.ids) and len(x.ids) else np.full(len(q.ids), _LEAST)
        return pd.DataFrame({"row": cell["row"].to_numpy()[side], "floor": found})

    width = F.size("v").alias("width")
    seeds = stage_table(first.groupBy("block", "part", width).applyInPandas(floors, "row long, floor long"), "floors")
    right = right.join(seeds, "row").withColumn("block", seq(columns))

    def search(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        side, q, x = _blocks(cell)
        if not len(q.ids) or not len(x.ids):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        best = search_cell(q, x, k, cell["floor"].to_numpy(np.int64)[side])
        return pd.DataFrame({"query_id": np.repeat(q.ids, best.known.sum(axis=1)), "vec_id": best.ids[best.known], "score": best.scores[best.known]})

    cells = left.withColumn("part", seq(rows)).unionByName(right)
    found = cells.groupBy("block", "part", width).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """id and v = floor(256 * x) of each component x, in double. Rows with a null or non-finite component are left out."""
    finite = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    return embeddings.filter(finite).select(F.col("vec_id").cast("long").alias("id"), F.expr("transform(embedding, x -> cast(floor(256 * cast(x as double)) as bigint))").alias("v"))
