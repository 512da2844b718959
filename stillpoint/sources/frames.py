"""Frames: decoding videos, features of frames, and models as pluggable functions.

A decoder yields (frame_idx, rgb array, frames a second) of a file's bytes; a model is made once in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import pixels
from . import png

Decoder = Callable[[bytes], Iterator[tuple[int, np.ndarray, float]]]
_MODELS: dict[str, object] = {}


def opencv_decoder(data: bytes) -> Iterator[tuple[int, np.ndarray, float]]:
    """Frames by OpenCV, where it is installed."""
    import os
    import tempfile

    import cv2

    with tempfile.NamedTemporaryFile(suffix=".mp4", delete=False) as f:  # the library reads files only; gone before the next one
        f.write(data)
    video = cv2.VideoCapture(f.name)
    try:
        rate, i = video.get(cv2.CAP_PROP_FPS), 0
        while True:
            ok, frame = video.read()
            if not ok:
                return
            yield i, frame[:, :, ::-1], rate
            i += 1
    finally:
        video.release()
        os.unlink(f.name)


def sample_frames(spark: SparkSession, path: str, decoder: Decoder = opencv_decoder, interval: float = 0.5) -> DataFrame:
    """(video_id, sample_idx, frame_idx, ts, png) of every file: each ``interval`` seconds a frame. Unreadable files raise."""

    def work(batches):
        for files in batches:
            for name, data in zip(files["path"], files["content"], strict=True):
                rows = []
                for i, rgb, rate in decoder(bytes(data)):
                    if i % max(1, int(interval * rate) if rate > 0 else 1) == 0:
                        rows.append((name, len(rows), i, i / rate if rate > 0 else 0.0, png.encode(rgb)))
                if not rows:
                    raise ValueError(f"no frames in {name}")
                yield pd.DataFrame(rows, columns=["video_id", "sample_idx", "frame_idx", "ts", "png"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "video_id string, sample_idx int, frame_idx bigint, ts double, png binary")


def frame_features(frames: DataFrame, key: str = "video_id", width: int = pixels.METRIC_SIZE[0], height: int = pixels.METRIC_SIZE[1]) -> DataFrame:
    """(key, sample_idx, dhash, metrics..., content array<float>): hash, raw metrics and the content area at metric size."""
    names = ["dark", "bright", "edge", "text_lines", "entropy_256", "entropy", "buckets", "stddev", "neighbour_step", "sharpness"]
    key_type = frames.schema[key].dataType.simpleString()
    types = ", ".join(f"{n} {'bigint' if n == 'buckets' else 'double'}" for n in names)

    def work(batches):
        for rows in batches:
            if not len(rows):
                continue
            grey = [pixels.grey(png.decode(bytes(p))) for p in rows["png"]]
            small = np.stack([pixels.resize(g, width, height) for g in grey])
            area = [pixels.resize(pixels.content_crop(g), width, height, "bilinear").reshape(-1).astype(np.float32) for g in grey]
            out = {key: rows[key], "sample_idx": rows["sample_idx"], "dhash": [pixels.signed64(pixels.difference_hash(g)) for g in grey]}
            yield pd.DataFrame(out | pixels.frame_metrics(small) | {"content": area})

    return frames.select(key, "sample_idx", "png").mapInPandas(work, f"{key} {key_type}, sample_idx int, dhash bigint, {types}, content array<float>")


def with_model(df: DataFrame, name: str, make: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a model to batches of rows. It is made on first use in a worker and kept for its later tasks.

    Captions, text recognition, embeddings and speech are such models: ``apply`` gets the model and a batch.
    """

    def work(batches):
        if name not in _MODELS:
            _MODELS[name] = make()
        for rows in batches:
            yield apply(_MODELS[name], rows)

    return df.mapInPandas(work, schema)
