"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _forest(batches):
    """The edges of one task cut down to stars: (node, least node of its local component)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
    if pairs:
        u, v = np.array(pairs, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, label): the least id of the component, for every id of ``edges`` (a bigint, b bigint).

    Edges of equal or null ends are left out; an empty table gives none. Each round is written to the scratch folder,
    and a node's edges are only ever combined by minimum, so that a hub's edges need not meet in one task.
    """
    known = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    now = scratch.save(known.mapInArrow(_forest, "u bigint, v bigint").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["s"])
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, scratch.save(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(old)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
