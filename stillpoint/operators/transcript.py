"""Transcripts: subtitle lines, and the words spoken around a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segment import KEY


def clock(seconds: Column, decimal: str = ".") -> Column:
    """HH:MM:SS.mmm of seconds."""
    whole = F.floor(seconds)
    text = F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor(whole % 3600 / 60), seconds % 60)
    return text if decimal == "." else F.translate(text, ".", decimal)


def _trimmed() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")


def txt_lines(segments: DataFrame, key: str = KEY) -> DataFrame:
    """(key, seg_no, line): one line for each segment."""
    return segments.select(key, "seg_no", F.concat(F.lit("["), clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.lit("]  "), _trimmed()).alias("line"))


def srt_blocks(segments: DataFrame, key: str = KEY) -> DataFrame:
    """(key, seg_no, block): numbered from 1 within the recording, with a blank line after each."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("seg_no"))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), clock(F.col("start_s"), ","), F.lit(" --> "), clock(F.col("end_s"), ","), F.lit("\n"), _trimmed(), F.lit("\n\n"))
    return segments.withColumn("_n", number).select(key, "seg_no", block.alias("block"))


def vtt_blocks(segments: DataFrame, key: str = KEY) -> DataFrame:
    """(key, seg_no, block); seg_no -1 is the recording's header."""
    body = segments.select(key, F.col("seg_no").cast("bigint").alias("seg_no"), F.concat(clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.lit("\n"), _trimmed(), F.lit("\n\n")).alias("block"))
    head = segments.select(key).distinct().select(key, F.lit(-1).cast("bigint").alias("seg_no"), F.lit("WEBVTT\n\n").alias("block"))
    return head.unionByName(body)


def json_segments(segments: DataFrame, key: str = KEY) -> DataFrame:
    """(key, seg_no, json): start and end at three places, half to even, and the trimmed text."""
    return segments.select(key, "seg_no", F.to_json(F.struct(F.bround("start_s", 3).alias("start"), F.bround("end_s", 3).alias("end"), _trimmed().alias("text"))).alias("json"))


FORMATS = {"txt": txt_lines, "srt": srt_blocks, "vtt": vtt_blocks, "json": json_segments}


def transcript_window(samples: DataFrame, segments: DataFrame, radius: float = 5.0, key: str = KEY) -> DataFrame:
    """``transcript_window``: texts of the segments that overlap [ts - radius, ts + radius], in order, joined by spaces."""
    seg = segments.select(key, "seg_no", "start_s", "end_s", _trimmed().alias("_text")).where("_text <> ''")
    met = samples.select(key, "sample_idx", "ts").join(seg, key).where((F.col("end_s") >= F.col("ts") - radius) & (F.col("start_s") <= F.col("ts") + radius))
    said = met.groupBy(key, "sample_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "_text"))), lambda x: x["_text"]), " ").alias("transcript_window"))
    return samples.join(said, [key, "sample_idx"], "left").withColumn("transcript_window", F.coalesce("transcript_window", F.lit("")))
