"""Budgets: how many clusters a scene gets, how many samples may be rescued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from .segment import KEY


def scene_novelty(df: DataFrame, key: str = KEY, scene: str = "scene_id", hash_col: str = "dhash") -> DataFrame:
    """(key, scene, n, novelty): samples, and the mean hash distance between neighbours within the scene (0 if none)."""
    w = Window.partitionBy(key, scene).orderBy("sample_idx")
    step = hamming(F.col(hash_col), F.lag(hash_col).over(w))
    return df.withColumn("_d", step).groupBy(key, scene).agg(F.count("*").alias("n"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("novelty"))


def allocate(scenes: DataFrame, total: Column, key: str = KEY, scene: str = "scene_id", floor: int = 1) -> DataFrame:
    """``alloc``: largest-remainder shares of ``total`` by novelty (by size where nothing is novel), ``floor`` each at least.

    Fewer than ``floor`` for each scene leaves the floor at total // scenes. Ties of remainder go to the larger weight,
    then to the earlier scene.
    """
    every = Window.partitionBy(key)
    count = F.count("*").over(every)
    base = F.when(total <= 0, 0).when(total < floor * count, F.least(F.lit(floor), F.floor(total / count))).otherwise(floor).cast("bigint")
    weight = F.when(F.sum("novelty").over(every) <= 0, F.greatest(F.lit(1), F.col("n")).cast("double")).otherwise(F.col("novelty"))
    step = scenes.withColumn("_total", total.cast("bigint")).withColumn("_base", base).withColumn("_w", weight)
    step = step.withColumn("_rest", F.greatest(F.lit(0), F.col("_total") - F.sum("_base").over(every))).withColumn("_raw", F.col("_rest") * F.col("_w") / F.sum("_w").over(every))
    step = step.withColumn("_extra", F.floor("_raw")).withColumn("_left", F.col("_rest") - F.sum("_extra").over(every))
    rank = F.row_number().over(every.orderBy((F.col("_raw") - F.col("_extra")).desc(), F.col("_w").desc(), scene))
    return step.withColumn("alloc", F.col("_base") + F.col("_extra") + (rank <= F.col("_left")).cast("bigint")).drop("_total", "_base", "_w", "_rest", "_raw", "_extra", "_left")


def candidate_budget(base: Column, scenes: Column, times: int = 2) -> Column:
    """Scene-heavy recordings may have up to ``times`` the base number of clusters."""
    return F.when((base <= 0) | (scenes <= 0), 0).otherwise(F.greatest(base, F.least(scenes, base * times)))


def rescue_budget(clusters: Column, duration: Column) -> Column:
    return F.greatest(F.lit(3), F.bround(clusters * 0.35).cast("int"), F.least(F.lit(8), F.ceil(duration / 90.0)).cast("int"))


def rescue_ocr_cap(budget: Column, windows: Column, scenes: Column) -> Column:
    return F.least(F.lit(96), F.greatest(budget * 4, windows * 2 + scenes, F.lit(40)))


def rescue_limits(samples: DataFrame, clusters: int, eligible: str = "eligible", key: str = KEY, ts: str = "ts") -> DataFrame:
    """(key, rescue_budget, windows, scenes, ocr_cap, legacy_cap, tau_proxy) of each recording.

    Windows and scenes are counted over eligible samples; the proxy limit is the 75th percentile over all.
    """
    window = F.struct(F.coalesce("scene_id", F.lit(-1)).alias("s"), F.coalesce("temporal_window_id", F.lit(0)).alias("w"))
    found = samples.groupBy(key).agg(
        (F.max(ts) - F.min(ts)).alias("_duration"),
        F.count_distinct(F.when(F.col(eligible), window)).alias("windows"),
        F.count_distinct(F.when(F.col(eligible), F.col("scene_id"))).alias("scenes"),
        F.expr("percentile(proxy_content_score, 0.75D)").alias("tau_proxy"),
    )
    budget = found.withColumn("rescue_budget", rescue_budget(F.lit(clusters), F.col("_duration")))
    return budget.select(key, "rescue_budget", "windows", "scenes", rescue_ocr_cap(F.col("rescue_budget"), F.col("windows"), F.col("scenes")).alias("ocr_cap"), F.least(F.lit(60), F.col("rescue_budget") * 4).alias("legacy_cap"), "tau_proxy")
