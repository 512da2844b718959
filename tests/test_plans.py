"""The extraction plan, the sinks and the streams end to end."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from stillpoint.operators import qa, segment, survive
from stillpoint.plans import pipeline
from stillpoint.sources import frames, png, sinks
from stillpoint.streaming import folds


def recording(spark, name="v", n=40):
    rng = np.random.RandomState(2)
    texts = ["Draft form page 1 owner request review case", "Approved form page 2 owner request review case", "", "Section 3 spreadsheet figma_source.pdf totals rows columns values"]
    samples, feats, metrics, evid = [], [], [], []
    for i in range(n):
        block = i // 10
        samples.append((name, i, i * 15, i * 0.5))
        v = rng.normal(size=8) * 0.1 + np.eye(8)[block % 8]
        feats.append((name, i, int(block * 0x0F0F0F0F), [float(x) for x in v]))
        metrics.append((name, i, float(100 + i), 30.0, 4.0, 0.1, 0.1, 40.0, float(i % 3) / 3, float((i * 7) % 10) / 10, 40.0 if i % 10 == 0 and i else 1.0))
        evid.append((name, i, texts[block % 4], "a dialog" if block % 2 else None))
    return (
        spark.createDataFrame(samples, "video_id string, sample_idx int, frame_idx bigint, ts double"),
        spark.createDataFrame(feats, "video_id string, sample_idx int, dhash bigint, embedding array<double>"),
        spark.createDataFrame(metrics, "video_id string, sample_idx int, sharpness double, edge double, entropy double, dark double, bright double, stddev double, text double, proxy_content_score double, delta double"),
        spark.createDataFrame(evid, "video_id string, sample_idx int, ocr_text string, caption string"),
    )


def check_texts(result, texts):
    """All stages are there; what is read in the two text stages, and which tokens that leaves."""
    assert set(result.stages) == set(qa.STAGES)
    rows = lambda stage: {r.sample_idx: r for r in result.stages[stage].collect()}
    listed, batch, final = rows("proposal.rescue_shortlist"), rows("evidence.rescue_ocr_batch"), rows("evidence.final_ocr")
    proposed = set(rows("proposal.pass1_primary")) | set(rows("proposal.cluster_alt"))
    assert listed and set(listed) <= set(batch) <= set(listed) | proposed
    assert set(final) == set(rows("selection.after_rescue"))
    words = {i: set(texts[i].lower().split()) for i in final}
    for i, r in final.items():
        assert r.raw_token_count == len(words[i]) and r.cleaned_token_count == len(r.tokens)
        assert all(2 * sum(t in {w.replace(".", "") for w in ws} for ws in words.values()) <= len(final) for t in r.tokens)


def test_every_outcome(spark):
    """Each bucket from the stages that a target hits; the last of a target's stages decides."""
    cases = {
        "no_sample_near_target": [],
        "sampled_but_no_proposal_near_target": ["sampling"],
        "coarse_proposal_exists_but_not_selected": ["sampling", "proposal.pass1_primary"],
        "selected_but_not_retained_after_alt": ["sampling", "selection.after_rescue", "evidence.final_ocr"],
        "rescue_shortlisted_but_not_ocrd": ["sampling", "proposal.rescue_shortlist"],
        "rescue_ocrd_but_not_promoted": ["sampling", "proposal.rescue_shortlist", "evidence.rescue_ocr_batch"],
        "promoted_rescue_but_not_retained_after_alt": ["sampling", "proposal.rescue_shortlist", "evidence.rescue_ocr_batch", "selection.promoted_rescue_only"],
        "retained_after_alt_but_removed_by_survival_policy": ["sampling", "selection.retained_after_alt"],
        "present_after_selection_but_removed_by_survival_policy": ["selection.retained_after_alt", "survival.after_global_dedupe"],
        "present_pre_cap_but_removed_by_cap_or_policy": ["survival.after_content_area_veto", "survival.final_pre_cap"],
        "hit_direct": ["survival.final_pre_cap", "survival.final_post_cap"],
    }
    rows = [("v", s, k, 100.0 * k, [100.0 * k]) for k, stages in enumerate(cases.values()) for s in stages]
    rows.append(("v", "survival.final_post_cap", 99, 5000.0, [5000.0, 9000.0]))
    targets = [("v", b, 100.0 * k, 1.0) for k, b in enumerate(cases)] + [("v", "hit_lineage_only", 9000.0, 1.0)]
    targets = spark.createDataFrame(targets, "video_id string, label string, time_s double, tolerance double")
    found = qa.nearest_in_stage(targets, spark.createDataFrame(rows, "video_id string, stage string, sample_idx int, ts double, merged_timestamps array<double>"))
    got = {r.label: r.bucket for r in qa.outcomes(targets, found).collect()}
    assert len(got) == 12 and all(label == bucket for label, bucket in got.items())


def test_extraction_and_trace(spark, tmp_path):
    tables = recording(spark)
    result = pipeline.extract(*tables, pipeline.Config(pass1_clusters=6, max_output_frames=4))
    rows = result.selected.cache()
    got = rows.collect()
    assert 1 <= len(got) <= 4 and len({r.sample_idx for r in got}) == len(got)
    assert all(r.sample_idx in r.merged_from_sample_idxs for r in got)
    targets = spark.createDataFrame([("v", "near", float(got[0].ts), 2.25), ("v", "never", 500.0, 1.0)], "video_id string, label string, time_s double, tolerance double")
    buckets = {r.label: r.bucket for r in pipeline.trace_targets(result, targets).collect()}
    assert buckets == {"near": "hit_direct", "never": "no_sample_near_target"}
    check_texts(result, {r.sample_idx: r.ocr_text for r in tables[3].collect()})
    segs = spark.createDataFrame([("v", 0, 0.0, 3.0, " hello "), ("v", 1, 4.0, 30.0, "world")], "video_id string, seg_no int, start_s double, end_s double, text string")
    sinks.write_manifest(rows, str(tmp_path / "m"), segs)
    doc = json.loads(spark.read.text(str(tmp_path / "m")).first()["value"])
    assert doc["count"] == len(got) and all("transcript_window" in f for f in doc["frames"])


def test_two_recordings_are_worked_off_alone(spark):
    one, two = recording(spark, "a"), recording(spark, "b", 30)
    ids = lambda r, v: sorted(x.sample_idx for x in r.selected.where(F.col("video_id") == v).collect())
    both = pipeline.extract(*(x.unionByName(y).repartition(3) for x, y in zip(one, two, strict=True)))
    assert ids(both, "a") == ids(pipeline.extract(*one), "a") and ids(both, "b") == ids(pipeline.extract(*two), "b")


def test_file_names_round_as_binary_values(spark):
    got = spark.createDataFrame([(1, 0.125), (22, 2.675), (333, 10.0)], "frame_idx bigint, ts double").select(sinks.frame_name(F.col("frame_idx"), F.col("ts"))).collect()
    assert [r[0] for r in got] == [f"frame_{i:06d}_{t:.2f}s.png" for i, t in ((1, 0.125), (22, 2.675), (333, 10.0))]


def test_transcript_formats(spark, tmp_path):
    segs = spark.createDataFrame([("v", 0, 0.0, 3.5, " hello "), ("v", 1, 3661.25, 3662.0, "world")], "video_id string, seg_no int, start_s double, end_s double, text string")
    sinks.write_transcript(segs, str(tmp_path / "t"), "srt")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert "00:00:00,000 --> 00:00:03,500" in text and "01:01:01,250 --> 01:01:02,000" in text


def test_targets(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"time": 3, "anchor_tokens": ["a"]}, {"time": 4.5, "label": "x", "tolerance": 1}]}))
    got = sinks.load_targets(spark, str(tmp_path / "t.json")).orderBy("time_s").collect()
    assert [(r.label, r.time_s, r.tolerance, r.anchor_tokens) for r in got] == [("3.0", 3.0, 2.25, ["a"]), ("x", 4.5, 1.0, [])]


def test_frames_source(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]))

    def decoder(data):
        for i in range(10):
            yield i, np.full((20, 30, 3), 20 * data[0] + i, np.uint8), 4.0

    shots = frames.sample_frames(spark, str(tmp_path / "*.bin"), decoder)
    assert sorted((r.sample_idx, r.frame_idx, r.ts) for r in shots.where("video_id like '%0.bin'").collect()) == [(i, 2 * i, i * 0.5) for i in range(5)]
    feats = frames.frame_features(shots).collect()
    assert len(feats) == 10 and all(r.dhash == 0 and r.edge == 0.0 and len(r.content) == 160 * 90 for r in feats)
    assert png.decode(bytes(shots.first().png)).shape == (20, 30, 3)


def run_stream(spark, df, make, out, tmp_path, parts=3):
    """Feed rows in order of time as files, one a trigger."""
    src = tmp_path / "src"
    rows = df.orderBy("ts", "sample_idx").toPandas()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k * step : (k + 1) * step], df.schema).coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(out)


def test_stream_dwells_equal_batch(spark, tmp_path):
    df = recording(spark)[1].withColumn("ts", F.col("sample_idx") * 0.5).select("video_id", "sample_idx", "ts", "dhash")
    got = run_stream(spark, df, folds.stream_dwell_ids, "dwells", tmp_path)
    want = segment.dwell_ids(df).select("video_id", F.col("sample_idx").cast("bigint"), "ts", "dwell_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_adjacent_equals_batch(spark, tmp_path):
    base = [f"w{i}" for i in range(12)]
    rows = [("v", i, i * 10.0, base[: 11 + i % 2] if i % 5 else ["x", "y", str(i)], float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "video_id string, sample_idx int, ts double, tokens array<string>, candidate_score double")
    got = run_stream(spark, df, folds.stream_adjacent_dedupe, "adjacent", tmp_path)
    opened = got.where("merges_into is null").count()
    assert opened == survive.adjacent_dedupe(df).where("kept").count() and got.count() == 20
