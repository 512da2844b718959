"""Sinks: captions, manifests, transcripts, frames and traces. One document for each recording, whose rows the cap bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import screen_type
from ..operators.segment import KEY
from ..operators.transcript import FORMATS, transcript_window


def frame_name(frame_idx: Column, ts: Column) -> Column:
    """frame_%06d_%.2fs.png, with the time rounded half to even on its binary value."""
    return F.concat(F.lit("frame_"), F.lpad(frame_idx.cast("string"), 6, "0"), F.lit("_"), F.call_function("format_number", ts, F.lit("0.00")), F.lit("s.png"))


def without_empty(df: DataFrame, cols: list[str]) -> Column:
    """A JSON object of the columns; nulls and empty arrays are left out."""
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in cols]
    return F.to_json(F.struct(*kept))


def manifest_rows(selected: DataFrame, segments: DataFrame | None = None, key: str = KEY, radius: float = 5.0) -> DataFrame:
    """The selected rows with file name, screen type and the words spoken around them."""
    rows = transcript_window(selected, segments, radius, key) if segments is not None else selected.withColumn("transcript_window", F.lit(""))
    caption = F.col("caption") if "caption" in selected.columns else F.lit(None).cast("string")
    return rows.withColumn("path", frame_name(F.col("frame_idx"), F.col("ts"))).withColumn("screen_type", screen_type(F.col("tokens"), caption))


def manifest_documents(rows: DataFrame, key: str = KEY, schema_version: int = 1) -> DataFrame:
    """(key, value): one JSON document a recording, rows in order of time."""
    cols = [c for c in rows.columns if c not in (key, "embedding", "content", "png")]
    each = rows.select(key, F.struct("ts", "sample_idx").alias("_o"), without_empty(rows, cols).alias("_j"))
    joined = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda x: x["_j"]), ",").alias("_rows"), F.count("*").alias("_n"))
    head = F.concat(F.lit(f'{{"schema_version":{schema_version},"count":'), F.col("_n").cast("string"), F.lit(',"frames":['))
    return joined.select(key, F.concat(head, F.col("_rows"), F.lit("]}")).alias("value"))


# Columns that a caption row must have, and what others are where absent.
CAPTION_REQUIRED = ["caption", "caption_cluster", "merged_from", "clip_cluster", "clip_cluster_size"]


def caption_documents(rows: DataFrame, key: str = KEY) -> DataFrame:
    """(key, value): the JSON list of a recording's selected rows for captions.json; KeyError if a required column is absent."""
    absent = [c for c in CAPTION_REQUIRED if c not in rows.columns]
    if absent:
        raise KeyError(f"captions need {absent}")
    named = rows.withColumn("path", frame_name(F.col("frame_idx"), F.col("ts")))
    cols = [c for c in named.columns if c not in (key, "embedding", "content", "png")]
    each = named.select(key, F.struct("ts", "sample_idx").alias("_o"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("_j"))
    return each.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda x: x["_j"]), ","), F.lit("]")).alias("value"))


def write_manifest(selected: DataFrame, path: str, segments: DataFrame | None = None, key: str = KEY) -> None:
    manifest_documents(manifest_rows(selected, segments, key), key).write.mode("overwrite").partitionBy(key).text(path)


def write_transcript(segments: DataFrame, path: str, fmt: str = "txt", key: str = KEY) -> None:
    """Subtitle text by recording, in order; ``fmt`` is txt, srt, vtt or json."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    rows = FORMATS[fmt](segments, key)
    body = rows.columns[-1]
    text = F.col(body) if fmt in ("txt", "json") else F.regexp_replace(body, "\n$", "")
    rows.repartition(key).sortWithinPartitions(key, "seg_no").select(key, text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_frames(selected: DataFrame, frames: DataFrame, path: str, key: str = KEY) -> None:
    """The pictures of the selected rows as (file name, content); a late join, so that pixels don't travel before."""
    rows = selected.select(key, "sample_idx", frame_name(F.col("frame_idx"), F.col("ts")).alias("path")).join(frames.select(key, "sample_idx", "png"), [key, "sample_idx"])
    rows.write.mode("overwrite").partitionBy(key).parquet(path)


def write_trace(stages: dict[str, DataFrame], path: str) -> None:
    """Each stage's rows under its own name."""
    for name, rows in stages.items():
        rows.write.mode("overwrite").json(f"{path}/stage={name}")


def load_targets(spark, path: str) -> DataFrame:
    """Wanted times from JSON: a list, or an object with ``targets``; tolerance 2.25 and label by default."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("targets").alias("t")).select("t.*") if "targets" in raw.columns else raw
    if "time" not in rows.columns:
        raise ValueError("targets need a time")
    col = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t)
    time = col("time", "double")
    return rows.select(F.coalesce(col("label", "string"), time.cast("string")).alias("label"), time.alias("time_s"), F.coalesce(col("tolerance", "double"), F.lit(2.25)).alias("tolerance"), F.coalesce(col("anchor_tokens", "array<string>"), F.array().cast("array<string>")).alias("anchor_tokens"))
