"""The candidate row: four core fields and five nested groups, with strict updates and flat projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and types of the fields of each group.
CORE = {"sample_idx": "int", "frame_idx": "int", "timestamp": "double", "origin": "string"}
GROUPS = {
    "visual": {"clip_cluster": "int", "clip_cluster_size": "int", "cluster_role": "string", "cluster_alt_reason": "string", "cluster_diversity_distance": "double", "cluster_sharpness_ratio": "double", "sharpness": "double", "dhash": "bigint", "dhash_hex": "string"},
    "temporal": {"scene_id": "int", "dwell_id": "int", "temporal_window_id": "int", "temporal_window_seconds": "double"},
    "evidence": {
        "caption": "string", "caption_source": "string", "ocr_text": "string", "ocr_cache_source": "string", "ocr_tokens": "array<string>", "dedupe_tokens": "array<string>", "rescue_tokens": "array<string>",
        "ocr_line_signature": "array<string>", "field_signature": "array<string>", "raw_token_count": "int", "filtered_token_count": "int", "cleaned_token_count": "int", "cleaning_attrition_ratio": "double",
    },
    "selection": {
        "candidate_score": "double", "score": "double", "proxy_content_score": "double", "content_area_delta_score": "double", "content_area_previous_delta": "double", "content_area_next_delta": "double", "proposal_lane": "string",
        "end_of_dwell_bonus": "double", "rescue_origin": "string", "rescue_reason": "string", "rescue_priority": "int", "retention_reason": "string", "retention_candidate_reason": "string", "retention_rejected_reason": "string",
        "low_information_filter_reason": "string", "split_from_generic": "boolean",
    },
    "lineage": {
        "merged_from_sample_idxs": "array<int>", "merged_timestamps": "array<double>", "retention_reasons_seen": "array<string>", "rescue_origins_seen": "array<string>", "rescue_priorities_seen": "array<int>", "lineage_roles": "array<string>",
        "dedupe_stage": "string", "merge_reason": "string", "merged_from": "int", "merged_captions": "array<string>", "caption_cluster": "int",
    },
}
# Payloads that never stand in rows.
HEAVY = ("frame", "frames", "image", "images", "embedding", "embeddings", "model", "pixels", "png")
GROUP_OF = {f: g for g, fields in GROUPS.items() for f in fields}


def candidate_type(key: str = "video_id", key_type: str = "string") -> T.StructType:
    """The nested type; all group fields may be null."""
    nested = ", ".join(f"{g} struct<{','.join(f'{f}:{t}' for f, t in fields.items())}>" for g, fields in GROUPS.items())
    return T.StructType.fromDDL(f"{key} {key_type}, {', '.join(f'{f} {t}' for f, t in CORE.items())}, {nested}")


def nest(flat: DataFrame, key: str = "video_id", origin: str = "proposal") -> DataFrame:
    """Flat columns to candidate rows. Unknown columns raise TypeError, pixels and vectors ValueError.

    frame_idx is sample_idx where absent; lineage is the row itself where empty; arrays of sets are the caller's to sort.
    """
    heavy = [c for c in flat.columns if c in HEAVY]
    if heavy:
        raise ValueError(f"payloads don't belong in rows: {heavy}")
    unknown = [c for c in flat.columns if c not in GROUP_OF and c not in CORE and c != key]
    if unknown:
        raise TypeError(f"unknown fields: {unknown}")

    def col(name: str, kind: str) -> Column:
        return (F.col(name) if name in flat.columns else F.lit(None)).cast(kind)

    core = {"sample_idx": col("sample_idx", "int"), "frame_idx": F.coalesce(col("frame_idx", "int"), col("sample_idx", "int")), "timestamp": col("timestamp", "double"), "origin": F.coalesce(col("origin", "string"), F.lit(origin))}
    own = {"merged_from_sample_idxs": F.array(core["sample_idx"]), "merged_timestamps": F.array(core["timestamp"])}
    some = (F.size(F.coalesce(col("merged_from_sample_idxs", "array<int>"), F.array().cast("array<int>"))) > 0) & (F.size(F.coalesce(col("merged_timestamps", "array<double>"), F.array().cast("array<double>"))) > 0)

    def value(f: str, t: str) -> Column:
        return F.when(some, col(f, t)).otherwise(own[f]) if f in own else col(f, t)

    groups = [F.struct(*(value(f, t).alias(f) for f, t in fields.items())).alias(g) for g, fields in GROUPS.items()]
    return flat.select(key, *(c.alias(f) for f, c in core.items()), *groups)


def with_fields(rows: DataFrame, **updates: Column) -> DataFrame:
    """New rows with fields of groups or core replaced; a field that no group has raises TypeError."""
    out = rows
    for name, value in updates.items():
        if name in CORE:
            out = out.withColumn(name, value.cast(CORE[name]))
        elif name in GROUP_OF:
            out = out.withColumn(GROUP_OF[name], F.col(GROUP_OF[name]).withField(name, value.cast(GROUPS[GROUP_OF[name]][name])))
        else:
            raise TypeError(f"unknown field: {name}")
    return out


def flatten(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """All fields as columns."""
    return rows.select(key, *CORE, *(F.col(f"{g}.{f}").alias(f) for g, fields in GROUPS.items() for f in fields))


def trace_json(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, sample_idx, json): the flat fields that aren't null or empty."""
    flat = flatten(rows, key)
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if GROUPS.get(GROUP_OF.get(c, ""), {}).get(c, "").startswith("array") else F.col(c) for c in flat.columns if c != key]
    return flat.select(key, "sample_idx", F.to_json(F.struct(*kept)).alias("json"))
