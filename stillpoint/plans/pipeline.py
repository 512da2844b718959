"""The extraction plan: from samples, features, metrics and evidence of many recordings to the few samples that stay.

Stages are DataFrames of their own, so that each can be traced; wide columns (vectors, content areas, pixels) stay in
their side tables until a stage needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import allocate, attribution, merge, promote, propose, qa, segment, survive
from ..operators.segment import KEY
from ..scratch import Scratch


@dataclass(frozen=True)
class Config:
    """Limits of a run; the defaults suit half-second samples of screen recordings."""

    pass1_clusters: int = 15
    scene_delta: float = 27.0
    tiny_scene_seconds: float = 3.0
    scene_boundary: int = 18
    dwell_bits: int = 6
    alternate_bits: int = 12
    alternate_distance: float = 0.08
    max_output_frames: int | None = None
    near_time: dict = field(default_factory=dict)
    global_: dict = field(default_factory=dict)
    adjacent: dict = field(default_factory=dict)
    content: dict = field(default_factory=dict)


@dataclass
class Result:
    """What stays, and every stage on the way."""

    selected: DataFrame
    stages: dict[str, DataFrame]


#: What the text of a sample says, beside its tokens.
SAID = ["tokens", "rescue_tokens", "ocr_line_signature", "field_signature", "raw_token_count", "filtered_token_count", "cleaned_token_count", "cleaning_attrition_ratio", "caption_source"]


def _said(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ocr_text) and the columns of SAID; a token in over half of a recording's rows is no token."""
    return attribution.attribute(rows, key=key).withColumn("tokens", F.col("ocr_tokens")).select(*rows.columns, *SAID)


def _with_tokens(rows: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of SAID; rows that ``said`` doesn't know have no tokens."""
    joined = rows.join(said.select(key, "sample_idx", *SAID), [key, "sample_idx"], "left")
    return joined.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def extract(samples: DataFrame, features: DataFrame, metrics: DataFrame, evidence: DataFrame, config: Config = Config(), key: str = KEY) -> Result:
    """samples (key, sample_idx, frame_idx, ts); features (key, sample_idx, dhash, embedding); metrics (key, sample_idx,
    sharpness, edge, entropy, dark, bright, stddev, text, proxy_content_score, delta); evidence (key, sample_idx, ocr_text,
    caption). ``delta`` is the change of the content area from the sample before.

    Recordings of fewer than four samples are left out. A sample without ocr_text is none that was read: it has no tokens,
    and isn't in the stage evidence.rescue_ocr_batch. Each stage is written to the scratch folder, so that plans
    stay short and a lost executor costs one stage's tasks.
    """
    at = [key, "sample_idx"]
    save = Scratch(samples.sparkSession, "extract").save
    rows = save(segment.enough_samples(samples, 4, key).join(features.select(*at, "dhash"), at, "left").join(metrics, at, "left"), "sampling")
    stages = {"sampling": rows}
    # scenes, their budgets, and clusters within them
    w = Window.partitionBy(key).orderBy("sample_idx")
    cut = rows.withColumn("scene_id", F.sum((F.coalesce("delta", F.lit(0.0)) > config.scene_delta).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    scenes = segment.coalesce_scenes(segment.scene_ranges(cut, key, hash_col="dhash"), config.tiny_scene_seconds, config.scene_boundary, key)
    scened = save(segment.samples_in_scenes(rows, scenes, key), "scened")
    novelty = allocate.scene_novelty(scened, key)
    half = F.floor(F.sum("n").over(Window.partitionBy(key)) / 2)
    budget = allocate.candidate_budget(F.least(F.lit(config.pass1_clusters), half), F.count("*").over(Window.partitionBy(key)))
    shares = allocate.allocate(novelty, budget, key).select(key, "scene_id", "alloc")
    clusters = propose.cluster_scenes(scened.join(shares, [key, "scene_id"]).join(features.select(*at, "embedding"), at), key)
    scored = segment.dwell_bonus(scened, config.dwell_bits, key).withColumn("candidate_score", segment.representative_score(F.col("sharpness"), F.lit(0.0), F.col("end_of_dwell_bonus")))
    context = segment.window_ids(scored.join(segment.window_seconds(scored, key), key), F.col("window_seconds"), key).join(clusters.select(*at, "clip_cluster"), at, "left")
    context = save(context, "context")
    members = context.where("clip_cluster is not null").join(features.select(*at, "embedding"), at)
    best = propose.cluster_best(members.select(key, "clip_cluster", "candidate_score", "sample_idx", "sharpness"), key).select(*at, "clip_cluster_size", F.lit("primary").alias("cluster_role"))
    alternates = propose.cluster_alternates(members, key, hash_distance=config.alternate_bits, clip_distance=config.alternate_distance).select(key, F.col("alt_idx").alias("sample_idx"), "clip_cluster_size", F.lit("alt").alias("cluster_role"))
    proposed = save(context.join(best.unionByName(alternates), at), "proposed")
    stages |= {"proposal.pass1_primary": proposed.where("cluster_role = 'primary'"), "proposal.cluster_alt": proposed.where("cluster_role = 'alt'")}
    # the shortlist, read and judged against what is proposed
    eligible = context.join(proposed.select(*at, F.lit(False).alias("_free")), at, "left").withColumn("eligible", F.coalesce("_free", F.lit(True))).drop("_free")
    lanes = segment.local_peaks(eligible.withColumn("prev_delta", F.coalesce("delta", F.lit(0.0))).withColumn("next_delta", F.coalesce(F.lead("delta").over(w), F.lit(0.0))), "text", key)
    limits = save(allocate.rescue_limits(eligible, config.pass1_clusters, key=key), "limits")
    listed = propose.shortlist(save(lanes.join(limits, key), "lanes"), key)
    texts = evidence.select(*at, "ocr_text", "caption")
    vectors = features.select(*at, "embedding")
    bare = save(context.join(texts, at, "left").join(proposed.select(*at, "clip_cluster_size", "cluster_role"), at), "bare")
    wanted = save(context.join(texts, at, "left").join(listed.select(*at, "proposal_lane"), at), "wanted")
    # read first: the shortlist and the primaries that it is compared with; other primaries have no tokens yet
    compared = bare.join(promote.comparison_primaries(wanted, bare, key), at, "left_semi")
    batch = wanted.select(*at, "ts", "ocr_text").union(compared.select(*at, "ts", "ocr_text")).where("ocr_text is not null").distinct()
    read = save(_said(batch, key).drop("ocr_text"), "read")
    rescue = save(_with_tokens(wanted, read, key), "shortlist").join(vectors, at, "left")
    main = save(_with_tokens(bare, read, key), "main")
    judged = promote.judged(rescue, main.join(vectors, at, "left"), key).where("eligible").withColumn("rescue_priority", F.row_number().over(Window.partitionBy(key).orderBy(*promote.priority()))).join(limits.select(key, "rescue_budget"), key)
    promotion = judged.where(F.col("rescue_priority") <= F.col("rescue_budget")).select(*at, F.col("reason").alias("rescue_reason"), "rescue_priority", "primary_idx")
    rescued = save(promote.promoted_rows(rescue.drop("embedding"), promotion, main, key=key), "promoted")
    chosen = main.unionByName(rescued.drop("primary_idx"), allowMissingColumns=True)
    stages |= {"proposal.rescue_shortlist": rescue, "evidence.rescue_ocr_batch": read, "selection.promoted_rescue_only": rescued, "selection.after_rescue": chosen}
    # read again: every selected row, its tokens without those that most of the selected show
    told = _said(chosen.select(*at, "ocr_text"), key).drop("ocr_text")
    chosen = save(_with_tokens(chosen.drop(*SAID), told, key), "told")
    stages["evidence.final_ocr"] = chosen
    # what survives
    kept = save(survive.retain_alternates(chosen, key), "retained")
    stages["selection.retained_after_alt"] = kept
    for name, step, params in (("survival.after_near_dedupe", survive.near_time_dedupe, config.near_time), ("survival.after_global_dedupe", survive.global_dedupe, config.global_)):
        kept = save(survive.keep_survivors(kept, step(kept, key, **params), key), "survival")
        stages[name] = kept
    kept = save(survive.drop_low_information(kept, metrics, key), "survival")
    stages["survival.after_low_info_filter"] = kept
    kept = save(survive.keep_survivors(kept, survive.adjacent_dedupe(kept, key, **config.adjacent), key), "survival")
    stages["survival.after_adjacent_dedupe"] = kept
    verdicts = merge.pair_verdicts(kept, key, seconds=30.0)
    parts = save(merge.merge_components(kept, verdicts, key), "components")
    rolled = merge.lineage_rollup(kept.join(parts, at), ("component",), key).select(*at, "merged_from_sample_idxs", "merged_timestamps", "merged_captions", "merged_from", "component")
    kept = save(kept.drop("merged_from_sample_idxs").join(rolled, at), "merged")
    if "content" in metrics.columns:
        kept = save(survive.keep_survivors(kept, survive.content_dedupe(kept, key, **config.content), key), "survival")
    stages["survival.after_content_area_veto"] = kept
    final = survive.output_cap(kept, config.max_output_frames, key)
    stages |= {"survival.final_pre_cap": kept, "survival.final_post_cap": final.where("not capped_out")}
    return Result(stages["survival.final_post_cap"], stages)


def trace_targets(result: Result, targets: DataFrame, key: str = KEY) -> DataFrame:
    """Where each wanted time was lost: (key, label, bucket, best_family, best_stage, best_matched_via)."""
    parts = []
    for name, rows in result.stages.items():
        merged = F.col("merged_timestamps") if "merged_timestamps" in rows.columns else F.array("ts")
        parts.append(rows.select(key, F.lit(name).alias("stage"), "sample_idx", "ts", merged.alias("merged_timestamps")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return qa.outcomes(targets, qa.nearest_in_stage(targets, every, key), key)
