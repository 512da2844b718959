"""Proposals: best and alternate sample of a cluster, clustering of a scene, and the lanes of the rescue shortlist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import dot, hamming
from .segment import KEY


def cluster_best(df: DataFrame, key: str = KEY, cluster: str = "clip_cluster", keep: tuple[str, ...] = ()) -> DataFrame:
    """Best sample of each cluster by (score, sample_idx, sharpness): of equal scores the later one."""
    row = F.struct("candidate_score", "sample_idx", "sharpness", *keep)
    return df.groupBy(key, cluster).agg(F.max(row).alias("_b"), F.count("*").alias("clip_cluster_size")).select(key, cluster, "_b.*", "clip_cluster_size")


def cluster_alternates(df: DataFrame, key: str = KEY, cluster: str = "clip_cluster", hash_distance: int = 12, clip_distance: float = 0.08, sharpness_ratio: float = 0.5) -> DataFrame:
    """The alternate of each cluster: the best sample that is sharp enough and differs from the best one by hash or vector."""
    best = cluster_best(df, key, cluster, ("dhash", "embedding")).select(
        key, cluster, F.col("sample_idx").alias("best_idx"), F.col("sharpness").alias("_bs"), F.col("dhash").alias("_bh"), F.col("embedding").alias("_be"), "clip_cluster_size"
    )
    pair = df.join(best, [key, cluster]).where(F.col("sample_idx") != F.col("best_idx"))
    pair = pair.withColumn("ratio", F.col("sharpness") / F.greatest(F.col("_bs"), F.lit(1e-9))).withColumn("_hd", hamming(F.col("dhash"), F.col("_bh"))).withColumn("_cd", 1.0 - dot(F.col("_be"), F.col("embedding")))
    by_hash = F.coalesce(F.col("_hd") >= hash_distance, F.lit(False))
    pair = pair.where((F.col("ratio") >= sharpness_ratio) & (by_hash | (F.col("_cd") > clip_distance)))
    reason = F.when(by_hash, "dhash").otherwise("clip")
    distance = F.when(by_hash, F.col("_hd").cast("double")).otherwise(F.col("_cd"))
    row = F.struct("candidate_score", "sample_idx", "sharpness", reason.alias("reason"), distance.alias("distance"), "ratio")
    return pair.groupBy(key, cluster, "best_idx", "clip_cluster_size").agg(F.max(row).alias("_a")).select(key, cluster, "best_idx", "clip_cluster_size", F.col("_a.sample_idx").alias("alt_idx"), F.col("_a.reason").alias("reason"), F.col("_a.distance").alias("distance"), F.col("_a.ratio").alias("ratio"))


def sharpest(df: DataFrame, by: tuple[str, ...] = (KEY, "scene_id")) -> DataFrame:
    """The sharpest sample of each group, the first of equals."""
    best = F.max_by("sample_idx", F.struct("sharpness", -F.col("sample_idx")))
    return df.groupBy(*by).agg(best.alias("sample_idx"), F.max("sharpness").alias("sharpness"), F.count("*").alias("clip_cluster_size"))


def average_linkage(vectors: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage under cosine distance, numbered by first member.

    The nearest pair of clusters is joined until k are left; distances to the joined one are means weighted by size.
    """
    n = len(vectors)
    k = max(1, min(k, n))
    length = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / np.where(length == 0, 1, length)[:, None]
    d = 1.0 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    first = pd.unique(label)
    return np.searchsorted(np.sort(first), label) if len(first) == k else label


def cluster_scenes(df: DataFrame, key: str = KEY, scene: str = "scene_id") -> DataFrame:
    """(key, scene, sample_idx, clip_cluster) for samples with ``alloc`` and ``embedding``: each scene cut into alloc clusters.

    A scene without an allocation has no rows; one of a single cluster or sample is one cluster. Cluster numbers run
    through the recording in order of scenes.
    """
    types = df.select(key, scene, "sample_idx").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types) + ", _local int"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_idx")
        labels = average_linkage(np.array(rows["embedding"].tolist(), np.float64), int(rows["alloc"].iloc[0])) if len(rows) > 1 else np.zeros(len(rows), int)
        return rows[[key, scene, "sample_idx"]].assign(_local=labels.astype(np.int32))

    local = df.where(F.col("alloc") > 0).select(key, scene, "sample_idx", "embedding", "alloc").groupBy(key, scene).applyInPandas(work, schema)
    number = F.dense_rank().over(Window.partitionBy(key).orderBy(scene, "_local")) - 1
    return local.withColumn("clip_cluster", number).drop("_local")


def _ranking(*first: Column):
    return [*first, F.col("ts"), F.col("sample_idx")]


def content_lane(df: DataFrame, key: str = KEY, text_band: float = 0.2) -> DataFrame:
    """Samples where the content area changes, best first: (key, sample_idx, pos).

    Needs local_peaks() flags over all samples, ``eligible``, ``proxy_content_score`` and the limits of rescue_limits().
    The first and last sample, and recordings of fewer than three samples or without any delta over the floor, have none.
    """
    every = Window.partitionBy(key)
    inner = df.withColumn("_last", F.max("sample_idx").over(every)).where((F.col("sample_idx") > 0) & (F.col("sample_idx") < F.col("_last")) & F.col("eligible") & F.col("threshold").isNotNull())
    moves = inner.where(F.col("local_peak") | F.col("settled") | (F.col("band_change") >= text_band))
    score = F.greatest("prev_delta", "next_delta") / 255.0 + 0.25 * F.col("band_change") + 0.10 * F.col("proxy_content_score")
    cap = F.least(F.col("ocr_cap"), F.greatest(F.col("rescue_budget") * 2, F.col("windows") + F.col("scenes"), F.lit(8)))
    ranked = moves.withColumn("pos", F.row_number().over(every.orderBy(*_ranking(score.desc()))))
    return ranked.where(F.col("pos") <= cap).select(key, "sample_idx", "pos")


def coverage_lane(df: DataFrame, key: str = KEY, gap: float = 2.25) -> DataFrame:
    """Best sample of each window, then a second one apart from it, then the next best of scenes with several windows.

    (key, sample_idx, lane, pos); needs ``eligible``, scene_id, temporal_window_id, proxy_content_score.
    """
    rows = df.where("eligible").withColumn("_s", F.coalesce(F.col("scene_id").cast("bigint"), F.lit(-1).cast("bigint"))).withColumn("_w", F.coalesce(F.col("temporal_window_id"), F.lit(0)))
    per = Window.partitionBy(key, "_s", "_w")
    order = _ranking(F.col("proxy_content_score").desc())
    rows = rows.withColumn("_r", F.row_number().over(per.orderBy(*order))).withColumn("_first", F.min_by("ts", "_r").over(per)).withColumn("_far", F.abs(F.col("ts") - F.col("_first")) >= gap)
    second = F.row_number().over(Window.partitionBy(key, "_s", "_w", "_far").orderBy(*order))
    rows = rows.withColumn("_pick", F.when(F.col("_r") == 1, 1).when(F.col("_far") & (second == 1), 2))
    several = F.size(F.collect_set("_w").over(Window.partitionBy(key, "_s"))) > 1
    rows = rows.withColumn("_several", several & (F.col("_s") >= 0))
    third = F.row_number().over(Window.partitionBy(key, "_s", F.col("_pick").isNull()).orderBy(*order))
    rows = rows.withColumn("_pick", F.when(F.col("_pick").isNull() & F.col("_several") & (third == 1), 3).otherwise(F.col("_pick"))).where(F.col("_pick").isNotNull())
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_pick", "_s", "_w"))
    return rows.select(key, "sample_idx", F.when(F.col("_pick") == 3, "scene_coverage").otherwise("temporal_coverage").alias("lane"), pos.alias("pos"))


def legacy_lane(df: DataFrame, key: str = KEY, gap: float = 2.25, per_window: int = 3) -> DataFrame:
    """The lane by proxy score alone: (key, sample_idx, pos), ``legacy_cap`` samples of each recording at most.

    In order: the best over the recording's limit up to a quota; up to three samples of each window, ``gap`` apart; the
    best of each scene; the rest by score. A recording's eligible rows are one group of bounded size, worked off in order.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, sample_idx bigint, pos int"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["proxy_content_score", "ts", "sample_idx"], ascending=[False, True, True])
        cap, budget, limit = int(rows["legacy_cap"].iloc[0]), int(rows["rescue_budget"].iloc[0]), float(rows["tau_proxy"].iloc[0])
        lane: dict[int, None] = {}

        def take(i) -> bool:
            if len(lane) >= cap or i in lane:
                return False
            lane[int(i)] = None
            return True

        quota = min(cap, max(budget, cap // 4))
        for i in rows.loc[rows["proxy_content_score"] >= limit, "sample_idx"].head(quota):
            take(i)
        windows = sorted(rows.groupby(["_s", "_w"], sort=False), key=lambda g: (-g[1]["proxy_content_score"].max(), -len(g[1])))
        for _, group in windows:
            taken: list[float] = []
            for t, i in zip(group["ts"], group["sample_idx"], strict=True):
                if all(abs(t - x) >= gap for x in taken) and take(i):
                    taken.append(t)
                if len(taken) >= per_window or len(lane) >= cap:
                    break
        for _, group in rows[rows["_s"] >= 0].groupby("_s"):
            take(group["sample_idx"].iloc[0])
        for i in rows["sample_idx"]:
            take(i)
        return pd.DataFrame({key: rows[key].iloc[0], "sample_idx": list(lane), "pos": range(1, len(lane) + 1)})

    rows = df.where("eligible").select(
        key, F.col("sample_idx").cast("bigint").alias("sample_idx"), "ts", "proxy_content_score", F.coalesce(F.col("scene_id").cast("bigint"), F.lit(-1).cast("bigint")).alias("_s"), F.coalesce(F.col("temporal_window_id").cast("bigint"), F.lit(0).cast("bigint")).alias("_w"), "rescue_budget", "legacy_cap", "tau_proxy"
    )
    return rows.groupBy(key).applyInPandas(work, schema)


def shortlist(df: DataFrame, key: str = KEY) -> DataFrame:
    """Ordered union of the lanes and the rest by score, first lane wins, ``ocr_cap`` at most: (key, sample_idx, proposal_lane, rank)."""
    numbered = lambda lane, no, name=None: lane.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.lit(no).alias("_no"), "pos", (F.lit(name) if name else F.col("lane")).alias("proposal_lane"))
    rest = df.where("eligible").withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*_ranking(F.col("proxy_content_score").desc()))))
    lanes = numbered(content_lane(df, key), 1, "content_area_delta").unionByName(numbered(legacy_lane(df, key), 2, "legacy_proxy")).unionByName(numbered(coverage_lane(df, key), 3)).unionByName(numbered(rest, 4, "global_backfill"))
    once = lanes.withColumn("_r", F.row_number().over(Window.partitionBy(key, "sample_idx").orderBy("_no", "pos"))).where("_r = 1")
    caps = df.select(key, "ocr_cap").distinct()
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_no", "pos"))).join(caps, key)
    return ranked.where(F.col("rank") <= F.col("ocr_cap")).select(key, "sample_idx", "proposal_lane", "rank")
