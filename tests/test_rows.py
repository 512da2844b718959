"""Candidate rows, attribution, swaps and captions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from stillpoint import schema
from stillpoint.functions import policy
from stillpoint.operators import attribution, promote
from stillpoint.sources import sinks


def test_nest_and_flatten(spark):
    flat = spark.createDataFrame([("v", 3, 1.5, "primary", ["a"])], "video_id string, sample_idx int, timestamp double, cluster_role string, ocr_tokens array<string>")
    rows = schema.nest(flat)
    assert rows.schema.simpleString() == schema.candidate_type().simpleString()
    r = rows.first()
    assert (r.frame_idx, r.origin, r.visual.cluster_role, r.lineage.merged_from_sample_idxs, r.lineage.merged_timestamps) == (3, "proposal", "primary", [3], [1.5])
    with pytest.raises(TypeError):
        schema.nest(flat.withColumn("colour", F.lit(1)))
    with pytest.raises(ValueError):
        schema.nest(flat.withColumn("embedding", F.array(F.lit(1.0))))
    new = schema.with_fields(rows, scene_id=F.lit(4), origin=F.lit("rescue")).first()
    assert (new.temporal.scene_id, new.origin, new.visual.cluster_role) == (4, "rescue", "primary")
    with pytest.raises(TypeError):
        schema.with_fields(rows, colour=F.lit(1))
    doc = json.loads(schema.trace_json(rows).first().json)
    assert doc["ocr_tokens"] == ["a"] and "caption" not in doc and "rescue_tokens" not in doc
    assert schema.flatten(rows).first().cluster_role == "primary"


def test_attribution(spark):
    df = spark.createDataFrame([("v", 0, "Menu Draft page3 alpha.pdf"), ("v", 1, "Menu beta"), ("v", 2, "Menu"), ("w", 0, "lonely word"), ("w2", 0, None)], "video_id string, sample_idx int, ocr_text string")
    got = {(r.video_id, r.sample_idx): r for r in attribution.attribute(df).collect()}
    first = got["v", 0]
    assert first.filtered_text == "Draft page3 alpha.pdf" and first.ocr_tokens == ["alphapdf", "draft", "page3"] and "alpha.pdf" in first.rescue_tokens
    assert (first.raw_token_count, first.filtered_token_count, first.cleaned_token_count, first.cleaning_attrition_ratio) == (4, 3, 3, 0.25)
    assert got["v", 2].filtered_text == "" and got["w", 0].filtered_text == "" and got["w2", 0].raw_token_count == 0
    have = spark.createDataFrame([("v", 0, "old"), ("v", 1, None)], "video_id string, sample_idx int, ocr_text string")
    new = spark.createDataFrame([("v", 0, "new"), ("v", 1, "new")], "video_id string, sample_idx int, text string")
    assert [r.ocr_text for r in attribution.cached_text(have, new).orderBy("sample_idx").collect()] == ["old", "new"]


def swap(spark, rescue, base, added=(), budget=3):
    cols = "video_id string, sample_idx bigint, ts double, tokens array<string>, scene_id bigint, clip_cluster bigint, proxy_content_score double"
    make = lambda rows: spark.createDataFrame([("v", *r) for r in rows], cols)
    promoted = spark.createDataFrame([("v", *r) for r in added], "video_id string, sample_idx bigint, primary_idx bigint")
    return sorted((r.sample_idx, r.rescue_reason, r.rescue_origin, r.primary_idx) for r in promote.swap_promotion(make(rescue), make(base), promoted, budget).collect())


def test_swaps(spark):
    base = [(0, 0.0, ["alpha"], 1, 7, 0.2), (9, 90.0, ["beta", "page1"], 2, 8, 0.2)]
    more = (1, 10.0, ["alpha", "file.pdf", "x", "y"], 1, 7, 0.9)
    assert swap(spark, [more], base) == [(1, "content_reference", "same_cluster_swap", 0)]
    # another cluster, the same scene
    assert swap(spark, [(*more[:4], 5, more[5])], base) == [(1, "content_reference", "same_scene_generic_primary_swap", 0)]
    # no budget left, not a superset, and no reason
    assert swap(spark, [more], base, added=[(1, 0)], budget=1) == []
    assert swap(spark, [(1, 10.0, ["file.pdf", "x", "y"], 1, 7, 0.9)], base) == []
    assert swap(spark, [(*more[:5], 0.2)], base) == []
    # once swapped, the new row is what later rows meet
    later = (2, 11.0, ["alpha", "file.pdf", "x", "y", "z"], 1, 7, 0.95)
    assert swap(spark, [more, later], base) == [(1, "content_reference", "same_cluster_swap", 0)]


def test_captions_need_their_columns(spark):
    rows = spark.createDataFrame([("v", 0, 7, 1.0, "c", 0, 1, 2, 3)], "video_id string, sample_idx int, frame_idx bigint, ts double, caption string, caption_cluster int, merged_from int, clip_cluster int, clip_cluster_size int")
    doc = json.loads(sinks.caption_documents(rows).first().value)
    assert doc[0]["path"] == "frame_000007_1.00s.png" and doc[0]["caption"] == "c"
    with pytest.raises(KeyError):
        sinks.caption_documents(rows.drop("caption"))


WORDS = ["page", "page1", "page2", "3", "1/2", "option1", "section2b", "approved", "draft", "pending", "please", "selection", "date", "field", "12mar2024", "file", "a.pdf", "x", "y", "z", "w"]


def test_words_are_the_rules():
    """What is found once for a set says the same as the rules over sets."""
    rng = random.Random(3)
    sets = [frozenset(rng.sample(WORDS, rng.randrange(8))) for _ in range(120)]
    sets += [s | {"x", "y"} for s in sets[:60]]
    for a in sets:
        x = policy.Words(a)
        assert dict(zip(policy.KINDS, x.strict, strict=True)) == policy.strict_markers(a) and x.marked == any(policy.strict_markers(a).values())
        assert x.raw == policy.Sample(0, 0.0, a).marked and x.refers == policy.refers(a)
        for b in sets:
            y = policy.Words(b)
            assert (x.form_gained(y), x.strictly_subsumes(y), x.worth_keeping(y), x.same_markers(y)) == (policy.form_gained(a, b), policy.strictly_subsumes(a, b), policy.worth_keeping(a, b), policy.same_markers(a, b))


def plain_swaps(rescue, base, added, budget):
    """The swaps of one recording, each row against all others; rows are (idx, ts, tokens, scene, cluster, score, embedding, rank)."""
    keys = ("idx", "ts", "tokens", "scene", "cluster", "score", "vector", "rank")
    row = lambda r: dict(zip(keys, r, strict=True)) | {"tokens": frozenset(r[2] or ()), "score": r[5] or 0.0}
    time = lambda r: (r["ts"], r["idx"])
    now = sorted(map(row, base), key=time)
    cluster = {c["idx"]: c["cluster"] for c in now}
    extra = sorted((row(r) for r in rescue if r[0] in added), key=time)
    now += [x | {"cluster": x["cluster"] if (c := cluster.get(added[x["idx"]])) is None else c} for x in extra]
    near = lambda a, b: a["scene"] == b["scene"] and abs(a["ts"] - b["ts"]) <= promote.TOLERANCE
    out = []
    waiting = sorted(map(row, rescue), key=lambda x: x["rank"])
    for origin, of in (("same_cluster_swap", "cluster"), ("same_scene_generic_primary_swap", "scene")):
        for x in waiting:
            if len(extra) + len(out) >= budget or any(c["idx"] == x["idx"] for c in now):
                continue
            main = min((c for c in now if c[of] == x[of] and (of == "cluster" or x[of] is not None)), key=lambda c: abs(c["ts"] - x["ts"]), default=None)
            if main is None or policy.form_gained(x["tokens"], main["tokens"]) or not policy.strictly_subsumes(x["tokens"], main["tokens"]):
                continue
            if near(x, main) and x["vector"] and main["vector"] and sum(p * q for p, q in zip(x["vector"], main["vector"], strict=True)) >= 0.93 and policy.jaccard(x["tokens"], main["tokens"]) >= 0.7:
                continue
            covered = any(near(x, c) and policy.same_markers(x["tokens"], c["tokens"]) for c in now)
            clears = x["score"] >= main["score"] * 1.3 and x["score"] - main["score"] >= 0.15
            if any(policy.strict_markers(x["tokens"]).values()) and not policy.Sample(0, 0.0, main["tokens"]).marked and policy.worth_keeping(main["tokens"], x["tokens"]) and not covered:
                reason = "evidence_marker"
            elif clears and policy.refers(x["tokens"]):
                reason = "content_reference"
            elif clears and len(x["tokens"] - main["tokens"]) >= 3 and len(x["tokens"]) >= 4:
                reason = "token_gain"
            else:
                continue
            if main["cluster"] is not None:
                x["cluster"] = main["cluster"]
            now[next(n for n, c in enumerate(now) if c is main)] = x
            out.append((x["idx"], reason, origin, main["idx"]))
    return out


def test_swaps_in_one_pass(spark):
    """The additive promotion within the fold is that of the columns, and the swaps are those of plain Python: unknown scenes, clusters, scores and tokens, ties, ranks, vectors, no candidates."""
    rng = random.Random(11)
    cols = "video_id string, sample_idx bigint, ts double, tokens array<string>, scene_id bigint, clip_cluster bigint, proxy_content_score double, embedding array<double>, rank bigint"
    made = {"rescue": {}, "base": {}}
    for n in range(120):
        for kind, least, most in (("rescue", 1, 14), ("base", 0, 12)):
            rows = []
            for k in range(rng.randint(least, most) if (n, kind) != (7, "base") else 0):
                tokens = rng.sample(WORDS[-5:] if kind == "base" and rng.random() < 0.6 else WORDS, rng.randrange(3) if kind == "base" else rng.randrange(9))
                vector = rng.choice([None, [1.0, 0.0], [0.96, 0.28], [0.0, 1.0]])
                rows.append((2 * k + (kind == "base") * (rng.random() < 0.9), rng.randrange(24) * 0.5, None if rng.random() < 0.04 else tokens, rng.choice([None, 0, 0, 1]), rng.choice([None, 0, 0, 1]), rng.choice([None, 0.1, 0.5, 0.9]), vector))
            ranks = rng.sample(range(50), len(rows))
            made[kind][f"v{n}"] = [(*r, k) for r, k in zip(rows, ranks, strict=True)]
    make = lambda kind: spark.createDataFrame([(v, *r) for v, rows in made[kind].items() for r in rows], cols).repartition(3).cache()
    rescue, base = make("rescue"), make("base")
    added = promote.additive_promotion(rescue, base, 2).cache()
    rows = lambda df: sorted((r.video_id, r.sample_idx, r.rescue_reason, r.rescue_origin, r.primary_idx) for r in df.collect())
    by_columns = rows(promote.swap_promotion(rescue, base, added, 6))
    assert rows(promote.swap_promotion(rescue, base, 2, 6)) == by_columns
    both = rescue.withColumn("listed", F.lit(True)).unionByName(base.withColumn("listed", F.lit(False)))
    assert rows(promote.swap_promotion_within(both, 2, 6)) == by_columns
    of = {v: {} for v in made["rescue"]}
    for r in added.collect():
        of[r.video_id][r.sample_idx] = r.primary_idx
    want = sorted((v, *x) for v in of for x in plain_swaps(made["rescue"][v], made["base"][v], of[v], 6))
    assert by_columns == want and len(want) > 40 and len({x[2:4] for x in want}) >= 4
