"""Best-fit packing of token pieces into sequences, planned by linear grouping.

Method. All that the plan needs of the corpus is the number of pieces of each length, at most ``capacity`` numbers.
Large lengths are sorted and cut into groups of equal cardinality, each rounded up to its longest; a linear program over
configurations of these few sizes is solved by column generation and rounded down. Actual lengths then take the places of
their group, longest first; the few that the rounding left over and all small pieces go best-fit, longest first, into
the tightest sequence that holds them. Equal sequences are kept as one class with a multiplicity, so plan
and time do not grow with the corpus. A plan maps runs of the ranks of a length to runs of sequences; each piece finds
its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, word_bpe
from ..scratch import Scratch
from .textio import slices, texts_of

CAPACITY = 4096
END_ID = 1
#: Lengths over this share of the capacity are large.
SMALL = 1 / 8
#: Numbers of groups that are tried; the plan of fewest sequences is taken.
GROUPS = (32, 64, 96)


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Cut lengths, longest first, into groups of equal cardinality: each a list of runs (length, count)."""
    total = int(counts.sum())
    out: list[list[tuple[int, int]]] = [[]]
    goal, room = -(-total // groups), -(-total // groups)
    for n, c in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while c:
            take = min(c, room)
            out[-1].append((n, take))
            c -= take
            room -= take
            if not room:
                out.append([])
                room = goal
    return [g for g in out if g]


def best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest worth that fits: a knapsack over all capacities."""
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-worth / np.array(sizes), kind="stable"):
        if worth[i] <= 1e-12:
            continue
        for _ in range(capacity // sizes[i]):
            new = best[: capacity + 1 - sizes[i]] + worth[i]
            better = new > best[sizes[i] :] + 1e-12
            if not better.any():
                break
            mark = np.zeros(capacity + 1, bool)
            mark[sizes[i] :] = better
            best = best.copy()
            best[sizes[i] :][better] = new[better]
            steps.append((int(i), mark))
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for i, mark in reversed(steps):
        if mark[room]:
            pattern[i] += 1
            room -= sizes[i]
    return float(pattern @ worth), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(configuration, times), rounded down, of the linear program that covers the demand: column generation by the revised simplex method."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(np.float64)
    need = np.array(demand, np.float64)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ need
        worth = inverse.sum(axis=0)  # duals: each configuration costs one sequence
        value, pattern = best_pattern(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-10, x / np.where(move > 1e-10, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    x = np.maximum(np.linalg.inv(basis) @ need, 0)
    chosen = [(basis[:, j].astype(np.int64), int(x[j] + 1e-9)) for j in range(k) if int(x[j] + 1e-9)]
    return chosen


class Plan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on, ``each`` to a sequence, from ``sequence`` on, at ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS[0]):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, sequence, each, offset
        self.sequences = 0
        self._next = dict.fromkeys(histogram, 0)
        self._open: dict[int, list[tuple[int, int]]] = {}  # free tokens: classes (first sequence, how many)
        self._free: list[int] = []
        large = sorted(n for n in histogram if n > capacity * small and histogram[n])
        rest = {n: c for n, c in histogram.items() if n <= capacity * small and c}
        if large:
            rest |= self._large(np.array(large), np.array([histogram[n] for n in large]), groups)
        for n in sorted(rest, reverse=True):
            self._best_fit(n, rest[n])
        self.runs.sort()

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self._next[length], count, sequence, each, offset))
        self._next[length] += count

    def _put(self, free: int, sequence: int, times: int) -> None:
        if free and times:
            if not self._open.get(free):
                self._open[free] = []
                bisect.insort(self._free, free)
            self._open[free].append((sequence, times))

    def _large(self, lengths: np.ndarray, counts: np.ndarray, groups: int) -> dict[int, int]:
        """Fill the configurations; returns what the rounding left over."""
        parts = grouped(lengths, counts, groups)
        sizes, demand = [g[0][0] for g in parts], [sum(c for _, c in g) for g in parts]
        merged: dict[int, list[list[tuple[int, int]]]] = {}
        for g in parts:  # groups of one rounded size are one size
            merged.setdefault(g[0][0], []).append(g)
        need = {s: 0 for s in merged}
        for s, d in zip(sizes, demand, strict=True):
            need[s] += d
        sizes = list(need)
        queues = [[list(r) for g in merged[s] for r in g] for s in sizes]
        for pattern, times in configurations(sizes, [need[s] for s in sizes], self.capacity):
            classes = [(self.sequences, times, 0)]
            self.sequences += times
            for i in range(len(sizes)):
                for _ in range(int(pattern[i])):
                    filled = []
                    for first, n, used in classes:
                        while n and queues[i]:
                            run = queues[i][0]
                            c = min(n, run[1])
                            self._take(run[0], c, first, 1, used)
                            filled.append((first, c, used + run[0]))
                            first, n = first + c, n - c
                            run[1] -= c
                            if not run[1]:
                                queues[i].pop(0)
                        if n:  # the demand is met: these places stay free
                            filled.append((first, n, used))
                    classes = filled
            for first, n, used in classes:
                self._put(self.capacity - used, first, n)
        left: dict[int, int] = {}
        for length, count in (r for q in queues for r in q):
            left[length] = left.get(length, 0) + count
        return left

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self._free, length)
            if k == len(self._free):
                each = self.capacity // length
                times = -(-count // each)
                self._put(self.capacity, self.sequences, times)
                self.sequences += times
                continue
            free = self._free[k]
            first, times = self._open[free].pop()
            if not self._open[free]:
                del self._open[free]
                self._free.pop(k)
            each = free // length
            full = min(times, count // each)
            if full:
                self._take(length, full * each, first, each, self.capacity - free)
                self._put(free - each * length, first, full)
                count -= full * each
                first, times = first + full, times - full
            if times and count:  # fewer than a sequence's worth is left
                self._take(length, count, first, count, self.capacity - free)
                self._put(free - count * length, first, 1)
                count, first, times = 0, first + 1, times - 1
            self._put(free, first, times)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (length, rank) as one number, and the runs as columns."""
        runs = np.array(self.runs, np.int64).reshape(-1, 6)
        return runs[:, 0] * (1 << 50) + runs[:, 1], runs

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        keys, runs = self._arrays if hasattr(self, "_arrays") else self.__dict__.setdefault("_arrays", self.arrays())
        r = runs[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
        t = rank - r[:, 1]
        return r[:, 3] + t // r[:, 4], r[:, 5] + (t % r[:, 4]) * length


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each row's ids and then ``end_id``, cut into pieces of ``capacity`` only if longer."""
    path = path or default_path()
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        bpe = word_bpe(path)
        for b in slices(batches, "text", 2 << 20):
            lists = [bpe.words(t) for t in texts_of(b)]
            bpe.learn(set().union(*lists))
            row, piece, start, length, crc = [], [], [], [], []
            for i, ws in enumerate(lists):
                data = b"".join(map(bpe.ids.__getitem__, ws)) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def ranked(pieces: DataFrame, id_col: str, rows_per_part: int = 100_000) -> DataFrame:
    """The pieces with ``rank``, 0 and up within each length, without bringing a length together: parts count first.

    Pieces are dealt to parts by hash; a part's ranks start where the parts before it end. Equal rows are exchangeable.
    """
    n = pieces.count()
    parts = max(16, -(-n // rows_per_part))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32", "start"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_part"), "length", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy(id_col, "piece", "ids_crc32"))
    return dealt.withColumn("_own", own).join(offsets, ["_part", "length"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, small: float = SMALL, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null text is the empty text, a piece of the end id alone; a null id stays null; repeated rows are packed each; other
    columns are not read; an empty table gives no rows. The driver receives one count for each length.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(df, id_col, text_col, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = min((Plan(histogram, capacity, small, g) for g in groups), key=lambda p: p.sequences)
    shared = spark.sparkContext.broadcast(plan)
    rows = ranked(pieces, id_col).select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32", "rank")

    def run(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = shared.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
