"""Approximate nearest neighbours with an inverted multi-index.

Method. Unit vectors are cut into two halves, each quantised with its own centroids; a pair of centroids is a cell. A
query walks the cells that have entries by the sum of its two distances, with a heap over pairs of its sorted distances,
until these hold enough entries; the sum at which it stops is its reach, and the entries of all cells within reach are reranked by
their exact cosine. Centroids grow with the square root of the number of entries, the entries that a query reaches with
its power 3/4: a smaller share of a larger table, at any size.

Cells lie in blocks of bounded size (large cells are split), and a query goes, with its reach, to the blocks that hold
one of its cells, so that no task sees more than a block of entries and a block of queries.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


@dataclass(frozen=True)
class Index:
    """Parameters of the index and of its search, for n entries."""

    #: Centroids of a half: fineness * sqrt(n), ``most`` at most; the driver holds ``most`` ** 2 counts.
    fineness: float = 4.0
    most: int = 1024
    #: Bound of the sample that the centroids are fitted on; all vectors are indexed.
    sample: int = 20_000
    rounds: int = 12
    #: Entries that a query's cells hold, at least: reach * n ** power.
    reach: float = 2.5
    power: float = 0.75
    #: Entries of a block, and queries that are worked off together.
    block: int = 4096
    queries: int = 256

    def centroids(self, n: int, sampled: int) -> int:
        return max(1, min(self.most, int(self.fineness * n**0.5), sampled // 4))

    def entries(self, n: int) -> int:
        return int(np.ceil(self.reach * n**self.power))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centroids of the rows of x; an empty one takes the row that lies farthest from its own."""
    rng = np.random.RandomState(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at, gap = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), 2048):
            d = distances(x[a : a + 2048], c)
            at[a : a + 2048], gap[a : a + 2048] = d.argmin(1), d.min(1)
        n = np.bincount(at, minlength=k)
        c = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None]
        far = np.argsort(-gap, kind="stable")
        for j, i in enumerate(np.flatnonzero(n == 0)):
            c[i] = x[far[j % len(x)]]
    return c


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = x / np.sqrt((x * x).sum(1))[:, None]
    return u[:, : x.shape[1] // 2], u[:, x.shape[1] // 2 :]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(1)[None] - 2 * x @ c.T + (x**2).sum(1)[:, None]


def rows_of(held: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each centroid of the first half: those of the second half with which it has entries, and how many."""
    return [(c := np.flatnonzero(row), row[c]) for row in held.reshape(-1, k)]


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, need: int, rows: list | None = None) -> tuple[list[int], float]:
    """Cells with entries by summed distance, until they hold ``need`` entries, and the last one's sum.

    The multi-sequence walk, with a heap: each opened row (a centroid of the first half) has its next pair in it. A row
    is sorted only when its least possible sum is due, and cells without entries are never visited. ``rows`` is
    rows_of(held).
    """
    k = len(d2)
    rows = rows if rows is not None else rows_of(held, k)
    o1 = np.argsort(d1, kind="stable").tolist()
    s1, least = d1[o1].tolist(), float(d2.min())
    replace, push, pop = heapq.heapreplace, heapq.heappush, heapq.heappop
    # (sum, row, place in the row), the place -1 for a row that isn't open yet
    heap: list[tuple[float, int, int]] = [(s1[0] + least, 0, -1)]
    opened: dict[int, tuple[list, list, list]] = {}
    out, got, far = [], 0, -np.inf
    while heap and got < need:
        total, i, j = heap[0]
        if j < 0:
            pop(heap)
            if i + 1 < len(o1):
                push(heap, (s1[i + 1] + least, i + 1, -1))
            cols, counts = rows[o1[i]]
            if len(cols):
                gap = d2[cols]
                order = np.argsort(gap, kind="stable")
                opened[i] = ((gap[order] + s1[i]).tolist(), (cols[order] + o1[i] * k).tolist(), counts[order].tolist())
                push(heap, (opened[i][0][0], i, 0))
            continue
        sums, cells, counts = opened[i]
        far = total
        out.append(cells[j])
        got += counts[j]
        if j + 1 < len(sums):
            replace(heap, (sums[j + 1], i, j + 1))
        else:
            pop(heap)
    return out, far


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: a row's id and components known and finite, not all zero."""
    v = F.transform(df[vec_col], lambda x: x.cast("double"))
    rows = df.select(df[id_col].cast("bigint").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    """n x d doubles of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Blocks:
    """Which block a cell's entries are in: cells in order, cut at ``size`` entries; a larger cell takes several blocks."""

    def __init__(self, held: np.ndarray, size: int):
        self.first, self.parts = np.zeros(len(held), np.int32), np.ones(len(held), np.int32)
        block, filled = 0, 0
        for cell in np.flatnonzero(held):
            n = int(held[cell])
            if filled and filled + n > size:
                block, filled = block + 1, 0
            self.first[cell], self.parts[cell] = block, -(-n // size)
            if n > size:
                block, filled = block + int(self.parts[cell]), 0
            else:
                filled += n
        self.count = block + 1


class Reranker:
    """The k best of a block's entries within reach, for batches of queries; every entry that could tie among them is scored exactly."""

    def __init__(self, parts: list[np.ndarray], ids: np.ndarray, x: np.ndarray, cells: np.ndarray, k: int):
        self.parts, self.ids, self.x, self.k = parts, ids, x, k
        self.norm = np.sqrt((x * x).sum(1))
        self.unit = x / self.norm[:, None]
        self.at = np.divmod(cells, len(parts[1]))

    def __call__(self, waiting: list[tuple]) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        asked, v, reach = np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting]), np.array([w[2] for w in waiting])
        length = np.sqrt((v * v).sum(1))
        first, second = (distances(h, p) for h, p in zip(halves(v), self.parts, strict=True))
        # the walk's sums, up to rounding
        rough = (v / length[:, None]) @ self.unit.T
        rough[(first[:, self.at[0]] + second[:, self.at[1]] > reach[:, None] + 1e-9) | (asked[:, None] == self.ids[None])] = -np.inf
        for i in range(len(waiting)):
            row = rough[i]
            pick = np.flatnonzero(row > -np.inf)
            if len(pick) > self.k:
                # rows of one id are listed once, by the nearest: they may not push others out
                best = _kth_id(row[pick], self.ids[pick], self.k)
                pick = pick[row[pick] >= best - 1e-9]
            if not len(pick):
                continue
            score = (self.x[pick] * v[i]).sum(1) / (self.norm[pick] * length[i])
            order = np.lexsort((self.ids[pick], -score))
            order = order[np.sort(np.unique(self.ids[pick[order]], return_index=True)[1])][: self.k]
            out[0].extend([int(asked[i])] * len(order))
            out[1].extend(self.ids[pick[order]].tolist())
            out[2].extend(score[order].tolist())
        return out


def _kth_id(scores: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The score of the k-th different id by score (of the last one, if there are fewer)."""
    take = k
    while True:
        top = np.argpartition(-scores, take - 1)[:take] if take < len(scores) else np.arange(len(scores))
        best: dict[int, float] = {}
        for i in top:
            best[int(ids[i])] = max(best.get(int(ids[i]), -np.inf), float(scores[i]))
        if len(best) >= k or take >= len(scores):
            return sorted(best.values(), reverse=True)[: min(k, len(best))][-1]
        take = min(len(scores), 4 * take)


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, index: Index = Index()) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest ids found, largest cosine first, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. Every row is an entry, and an id is as near as the nearest of its
    rows, those of a query's own id left out. Null ids and null, empty, zero and not finite vectors take no part; vectors
    are compared with those of their own length, each length by an index of its own; other columns are not read; an empty
    table gives no rows. The driver holds the centroids, fitted on a bounded sample, and one count a cell.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(usable(df, id_col, vec_col), "vectors")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect()
    found = [_search(rows.where(F.size("v") == r["dim"]), r["n"], is_query, k, index, scratch) for r in lengths]
    if not found:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    best = every.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _search(rows: DataFrame, n: int, is_query, k: int, index: Index, scratch: Scratch) -> DataFrame:
    """(query_id, id, score): the k best of each block within each query's reach, for ``n`` vectors of one length."""
    spark = rows.sparkSession
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(index.sample).collect()])
    size = index.centroids(n, len(sample))
    parts = [kmeans(h, size, index.rounds) if h.shape[1] else np.zeros((1, 0)) for h in halves(sample)]
    shared = spark.sparkContext.broadcast(parts)
    n2 = len(parts[1])

    def assign(batches):
        for b in batches:
            if b.num_rows:
                a, c = (distances(h, p).argmin(1) for h, p in zip(halves(_matrix(b.column(1))), shared.value, strict=True))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a * n2 + c, pa.int32())], ["id", "v", "cell"])

    entries = scratch.save(rows.mapInArrow(assign, "id bigint, v array<double>, cell int"), "entries")
    counts = entries.groupBy("cell").count().toArrow()
    held = np.zeros(len(parts[0]) * n2, np.int32)
    held[counts.column("cell").to_numpy()] = counts.column("count").to_numpy()
    blocks = Blocks(held, index.block)
    need = index.entries(n)
    plan = spark.sparkContext.broadcast((held, blocks.first, blocks.parts))

    def route(batches):
        """Queries with their reach, once for each block that holds a cell within it."""
        for whole in batches:
            held, first, many = plan.value
            listed = rows_of(held, n2)
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                d1, d2 = (distances(h, p) for h, p in zip(halves(_matrix(b.column(1))), shared.value, strict=True))
                at, to, reach = [], [], []
                for i in range(b.num_rows):
                    cells, far = walk(d1[i], d2[i], held, need, listed)
                    own = np.array(cells, np.int64)
                    wide = own[many[own] > 1]
                    blocks_of = np.unique(np.concatenate([first[own], *(first[c] + np.arange(many[c], dtype=np.int32) for c in wide)]))
                    at += [i] * len(blocks_of)
                    to.append(blocks_of)
                    reach += [far] * len(blocks_of)
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(reach, pa.float64())], ["block", "id", "v", "reach"])

    def deal(batches):
        for b in batches:
            _, first, many = plan.value
            cell, ids = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            block = first[cell] + (ids * 2654435761 >> 7) % many[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), b.column(0), b.column(1), b.column(2)], ["block", "id", "v", "cell"])

    asked = entries.where(is_query).select("id", "v").repartition(max(12, spark.sparkContext.defaultParallelism, n // 1_000_000), "id").mapInArrow(route, "block int, id bigint, v array<double>, reach double")
    stored = entries.mapInArrow(deal, "block int, id bigint, v array<double>, cell int")
    both = stored.select("block", "id", "v", "cell", F.lit(None).cast("double").alias("reach")).union(asked.select("block", "id", "v", F.lit(-1).alias("cell"), "reach"))

    def rerank(batches):
        block, ids, vectors, cells = None, [], [], []
        made: Reranker | None = None
        waiting: list[tuple] = []

        def emit():
            nonlocal made
            if ids and waiting:
                made = made or Reranker(shared.value, np.array(ids), np.array(vectors), np.array(cells), k)
                a, b, c = made(waiting)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "id", "score"])

        for b in batches:
            for k0, i, c, far, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), _matrix(b.column(2)), strict=True):
                if k0 != block:
                    yield from emit()
                    block, ids, vectors, cells, waiting, made = k0, [], [], [], [], None
                if far is None:
                    ids.append(i)
                    vectors.append(v.copy())
                    cells.append(c)
                else:
                    waiting.append((i, v.copy(), far))
                    if len(waiting) == index.queries:
                        yield from emit()
                        waiting = []
        yield from emit()

    tiles = both.repartition(max(blocks.count, spark.sparkContext.defaultParallelism), "block").sortWithinPartitions("block", F.col("reach").isNotNull())
    return tiles.mapInArrow(rerank, "query_id bigint, id bigint, score double")


def op3_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
