"""Segmentation of ordered samples: dwells, scenes, windows, neighbours, peaks and normalisation. Plain windows by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming

KEY = "video_id"


def _ordered(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*(order or ("ts", "sample_idx")))


def sample_every(df: DataFrame, every: int, key: str = KEY, frame: str = "frame_idx") -> DataFrame:
    """Keep every ``every``-th frame and number the kept ones from 0."""
    kept = df.where(F.col(frame) % max(1, every) == 0)
    return kept.withColumn("sample_idx", (F.row_number().over(_ordered(key, frame)) - 1).cast("int"))


def enough_samples(df: DataFrame, least: int = 4, key: str = KEY) -> DataFrame:
    """Only recordings with at least ``least`` samples."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(counts, key, "left_semi")


def dwell_ids(df: DataFrame, threshold: int = 6, key: str = KEY, order: tuple[str, ...] = ("sample_idx",), hash_col: str = "dhash") -> DataFrame:
    """``dwell_id``: a new one starts where the hash is more than ``threshold`` bits from the one before."""
    w = _ordered(key, *order)
    jump = F.coalesce(hamming(F.col(hash_col), F.lag(hash_col).over(w)) > threshold, F.lit(False))
    return df.withColumn("_jump", jump.cast("int")).withColumn("dwell_id", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def scene_cuts(df: DataFrame, value: str, threshold: float, key: str = KEY, order: tuple[str, ...] = ("sample_idx",)) -> DataFrame:
    """``scene_id``: a cut where ``value`` moves by more than ``threshold`` from the sample before."""
    w = _ordered(key, *order)
    cut = F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) > threshold, F.lit(False))
    return df.withColumn("_cut", cut.cast("int")).withColumn("scene_id", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def scene_ranges(df: DataFrame, key: str = KEY, scene: str = "scene_id", ts: str = "ts", hash_col: str | None = None) -> DataFrame:
    """(key, scene, s_idx, e_idx, s_ts, e_ts[, s_hash, e_hash]) of each scene."""
    ends = [F.min("sample_idx").alias("s_idx"), F.max("sample_idx").alias("e_idx"), F.min_by(ts, "sample_idx").alias("s_ts"), F.max_by(ts, "sample_idx").alias("e_ts")]
    if hash_col:
        ends += [F.min_by(hash_col, "sample_idx").alias("s_hash"), F.max_by(hash_col, "sample_idx").alias("e_hash")]
    return df.groupBy(key, scene).agg(*ends)


def coalesce_scenes(scenes: DataFrame, max_seconds: float = 3.0, boundary: int = 18, key: str = KEY) -> DataFrame:
    """Join scenes under ``max_seconds`` to the one before, unless the hashes at the boundary are ``boundary`` bits apart.

    A scene's fate depends on the scene before it alone, so this is a break flag and a running sum. A missing hash
    counts as a boundary. Returns (key, scene_id, s_idx, e_idx, merged).
    """
    w = Window.partitionBy(key).orderBy("s_idx", "e_idx")
    far = F.coalesce(hamming(F.lag("e_hash").over(w), F.col("s_hash")), F.lit(boundary)) >= boundary
    starts = F.lag("s_idx").over(w).isNull() | (F.col("e_ts") - F.col("s_ts") >= max_seconds) | far
    marked = scenes.withColumn("_break", starts.cast("int")).withColumn("_new", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(key, F.col("_new").alias("scene_id")).agg(F.min("s_idx").alias("s_idx"), F.max_by("e_idx", F.struct("s_idx", "e_idx")).alias("e_idx"), F.count("*").alias("merged"))


def samples_in_scenes(samples: DataFrame, scenes: DataFrame, key: str = KEY) -> DataFrame:
    """Samples with the scene that contains them; where scenes overlap the later one wins; null outside of all."""
    inside = scenes.select(F.col(key), "scene_id", F.explode(F.sequence("s_idx", "e_idx")).alias("sample_idx"))
    return samples.join(inside.groupBy(key, "sample_idx").agg(F.max("scene_id").alias("scene_id")), [key, "sample_idx"], "left")


def scenes_from_times(times: DataFrame, samples: DataFrame, key: str = KEY) -> DataFrame:
    """(start, end) times to sample ranges: the first sample at or after the start, the last at or before the end, clamped."""
    ends = samples.groupBy(key).agg(F.max("sample_idx").alias("_last"))
    joined = times.join(samples.select(key, "sample_idx", "ts"), key, "left").groupBy(key, "start", "end").agg(
        F.min(F.when(F.col("ts") >= F.col("start"), F.col("sample_idx"))).alias("s"), F.max(F.when(F.col("ts") <= F.col("end"), F.col("sample_idx"))).alias("e")
    )
    out = joined.join(ends, key)
    s = F.least(F.coalesce("s", F.col("_last")), F.col("_last"))
    return out.select(key, "start", "end", s.alias("s_idx"), F.greatest(s, F.coalesce("e", F.lit(0))).alias("e_idx"))


def window_seconds(df: DataFrame, key: str = KEY, ts: str = "ts", least: float = 20.0, times: float = 8.0, default: float = 0.5) -> DataFrame:
    """(key, window_seconds): ``times`` the median gap between samples, ``least`` at least."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(w)
    gaps = df.select(key, gap.alias("_gap"))
    return gaps.groupBy(key).agg(F.greatest(F.lit(least), times * F.coalesce(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(default))).alias("window_seconds"))


def window_ids(df: DataFrame, seconds: Column, key: str = KEY, ts: str = "ts", scene: str | None = "scene_id") -> DataFrame:
    """``temporal_window_id``: tumbling windows from the scene's first sample, or from 0 outside of scenes."""
    if scene is None:
        return df.withColumn("temporal_window_id", F.floor(F.col(ts) / seconds))
    start = F.min(ts).over(Window.partitionBy(key, scene))
    inside = F.floor(F.greatest(F.lit(0.0), F.col(ts) - start) / seconds)
    return df.withColumn("temporal_window_id", F.when(F.col(scene).isNull(), F.floor(F.col(ts) / seconds)).otherwise(inside))


def neighbour_deltas(df: DataFrame, value: str, key: str = KEY, order: tuple[str, ...] = ("sample_idx",)) -> DataFrame:
    """``prev_delta`` and ``next_delta``: absolute change from the sample before and to the one after, 0 at the ends."""
    w = _ordered(key, *order)
    before = F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(0.0))
    after = F.coalesce(F.abs(F.lead(value).over(w) - F.col(value)), F.lit(0.0))
    return df.withColumn("prev_delta", before).withColumn("next_delta", after)


def _with_quantile(df: DataFrame, name: str, value: Column, share: float, key: str = KEY) -> DataFrame:
    """Adds a quantile of a recording's values, nulls left out: between its neighbours in rank, as DuckDB's quantile_cont has it.

    What is compared with it needs its last bit: lo * (1 - d) and hi * d are added with one rounding (a fused multiply-add).
    """
    every = Window.partitionBy(key)
    out = df.withColumn("_x", value.cast("double")).withColumn("_place", (F.count("_x").over(every) - 1) * F.lit(share)).withColumn("_rank", F.row_number().over(every.orderBy(F.col("_x").asc_nulls_last())) - 1)
    at = lambda place: F.max(F.when(F.col("_rank") == place, F.col("_x"))).over(every)
    out = out.withColumn("_lo", at(F.floor("_place"))).withColumn("_hi", at(F.ceil("_place")))
    d = F.col("_place") - F.floor("_place")
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("_lo"), 1.0 - d, F.col("_hi") * d).cast("double")
    return out.withColumn(name, F.when(F.col("_lo").isNull() | (d == 0), F.col("_lo")).otherwise(between)).drop("_x", "_place", "_rank", "_lo", "_hi")


def local_peaks(df: DataFrame, band: str, key: str = KEY, order: tuple[str, ...] = ("sample_idx",), floor: float = 3.0, quantile: float = 0.7) -> DataFrame:
    """Flags of samples where the content moves: ``threshold``, ``local_peak``, ``settled``, ``band_change``.

    The threshold is a quantile of the deltas that reach ``floor``, by recording; null where none does.
    """
    w = _ordered(key, *order)
    df = _with_quantile(df, "threshold", F.when(F.col("prev_delta") >= floor, F.col("prev_delta")), quantile, key)
    limit = F.when(F.col("threshold").isNotNull(), F.greatest(F.lit(floor), F.col("threshold")))
    change = F.coalesce(F.abs(F.col(band) - F.lag(band).over(w)), F.lit(0.0))
    out = df.withColumn("threshold", limit).withColumn("band_change", change)
    over = F.col("prev_delta") >= F.col("threshold")
    return out.withColumn("local_peak", F.coalesce(over & (F.col("prev_delta") >= F.col("next_delta")), F.lit(False))).withColumn("settled", F.coalesce(over & (F.col("next_delta") <= F.greatest(F.lit(2.0), 0.6 * F.col("prev_delta"))), F.lit(False)))


def dwell_bonus(df: DataFrame, threshold: int = 6, key: str = KEY, order: tuple[str, ...] = ("sample_idx",), hash_col: str = "dhash") -> DataFrame:
    """``end_of_dwell_bonus``: 1 where both neighbours' hashes are within ``threshold`` bits; a missing one counts as equal."""
    w, h = _ordered(key, *order), F.col(hash_col)
    left, right = F.coalesce(F.lag(h).over(w), h), F.coalesce(F.lead(h).over(w), h)
    return df.withColumn("end_of_dwell_bonus", F.when(F.greatest(hamming(h, left), hamming(h, right)) <= threshold, 1.0).otherwise(0.0))


def representative_score(sharpness: Column, density: Column, bonus: Column) -> Column:
    """Sharpness (in thousands, 1.5 at most), transcript density and dwell bonus (clipped to 0..1), weighted."""
    clip = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.least(F.coalesce(sharpness, F.lit(0.0)) / 1000.0, F.lit(1.5)) + 0.75 * clip(density) + 0.5 * clip(bonus)


def min_max(value: Column, *by: str) -> Column:
    """(x - min) / (max - min) within the group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo))


def proxy_score(text: Column, edge: Column, ent: Column, dark: Column, bright: Column) -> Column:
    """How much a frame seems to show, 0 to 1, from normalised text lines, edges and entropy, less what is blank."""
    blank = 0.5 * F.greatest(F.lit(0.0), dark - 0.7) + 0.5 * F.greatest(F.lit(0.0), bright - 0.7)
    return F.least(F.greatest(0.45 * text + 0.30 * edge + 0.25 * (ent - blank), F.lit(0.0)), F.lit(1.0))


def bucket_entropy(df: DataFrame, value: str, width: float, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(by, buckets, entropy): Shannon entropy in bits of a histogram of ``width``-wide buckets, and how many aren't empty."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).alias("_b")).agg(F.count("*").alias("_c"))
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy(*by))
    return counts.withColumn("_p", share).groupBy(*by).agg(F.count("*").alias("buckets"), F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"))


def redundancy(df: DataFrame, close: Column, alike: Column, key: str = KEY) -> DataFrame:
    """(key, pairs, redundancy): share of neighbouring pairs that are both close and alike (columns of the later row)."""
    return df.groupBy(key).agg(F.count_if(close.isNotNull()).alias("pairs"), F.avg(F.when(close.isNotNull(), (close & alike).cast("double"))).alias("redundancy"))
