"""Structured Streaming forms of dwell segmentation and adjacent deduplication, windowed counts and sessions.

State is a recording's last samples only. Rows of a micro-batch are sorted by time before they are folded; a row that
is older than one already folded is late and left out, as a watermark would do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import policy
from ..functions.policy import Sample
from ..operators.segment import KEY


def stream_dwell_ids(stream: DataFrame, threshold: int = 6, key: str = KEY) -> DataFrame:
    """(key, sample_idx, ts, dwell_id) of a stream of (key, sample_idx, ts, dhash); the same ids as the batch form for ordered input."""
    key_type = stream.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, dwell, seen = state.get if state.exists else (None, 0, -1)
        rows = pd.concat(list(batches)).sort_values("sample_idx", kind="stable")
        out = []
        for i, t, h in zip(rows["sample_idx"].tolist(), rows["ts"].tolist(), rows["dhash"].tolist(), strict=True):
            if i <= seen:
                continue
            if last is not None and ((int(h) ^ last) & (2**64 - 1)).bit_count() > threshold:
                dwell += 1
            last, seen = int(h), int(i)
            out.append((k[0], seen, t, dwell))
        state.update((last, dwell, seen))
        yield pd.DataFrame(out, columns=[key, "sample_idx", "ts", "dwell_id"])

    rows = stream.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.col("ts").cast("double").alias("ts"), "dhash")
    return rows.groupBy(key).applyInPandasWithState(work, f"{key} {key_type}, sample_idx bigint, ts double, dwell_id bigint", "last bigint, dwell bigint, seen bigint", "append", GroupStateTimeout.NoTimeout)


def stream_adjacent_dedupe(stream: DataFrame, seconds: float = 90.0, threshold: float = 0.82, key: str = KEY) -> DataFrame:
    """(key, sample_idx, ts, merges_into) as rows arrive: null opens a new screen, else the last screen's sample it belongs to.

    ``merges_into`` names the sample that opened the screen; the screen's best sample so far is what further rows are
    compared with, as in the batch form. stream: (key, sample_idx, ts, tokens, candidate_score).
    """
    key_type = stream.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, first = None, None
        if state.exists:
            i, t, tokens, score, first = state.get
            best = Sample(i, t, frozenset(tokens.split("\x1f")) - {""}, score)
        rows = pd.concat(list(batches)).sort_values(["ts", "sample_idx"], kind="stable")
        out = []
        for r in rows.to_dict("records"):
            row = Sample(int(r["sample_idx"]), float(r["ts"]), frozenset(r["tokens"] if r["tokens"] is not None else ()), float(r["candidate_score"] or 0.0))
            if best is not None and row.ts < best.ts - seconds:
                continue
            same = best is not None and abs(row.ts - best.ts) <= seconds and row.tokens and best.tokens and policy.may_merge(row, best, threshold)
            if same:
                out.append((k[0], row.idx, row.ts, first))
                best = row if row.information() > best.information() else best
            else:
                best, first = row, row.idx
                out.append((k[0], row.idx, row.ts, None))
        if best is not None:
            state.update((best.idx, best.ts, "\x1f".join(sorted(best.tokens)), best.score, first))
        frame = pd.DataFrame(out, columns=[key, "sample_idx", "ts", "merges_into"])
        yield frame.astype({"merges_into": "Int64"})

    rows = stream.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.col("ts").cast("double").alias("ts"), "tokens", F.col("candidate_score").cast("double").alias("candidate_score"))
    return rows.groupBy(key).applyInPandasWithState(work, f"{key} {key_type}, sample_idx bigint, ts double, merges_into bigint", "idx bigint, ts double, tokens string, score double, first bigint", "append", GroupStateTimeout.NoTimeout)


def stream_window_counts(stream: DataFrame, window: str = "20 seconds", late: str = "10 seconds", key: str = KEY, time: str = "event_time") -> DataFrame:
    """Samples and mean value of each tumbling window of event time, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(key, F.window(time, window)).agg(F.count("*").alias("samples"), F.avg("value").alias("mean_value"))


def stream_sessions(stream: DataFrame, gap: str = "30 seconds", late: str = "10 seconds", key: str = KEY, time: str = "event_time") -> DataFrame:
    """Samples of each session of event time."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("samples"))
