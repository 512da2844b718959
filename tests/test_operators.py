"""Literal cases with known results."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillpoint.functions import evidence as ev
from stillpoint.functions import pixels, policy
from stillpoint.functions import tokens as tk
from stillpoint.functions.policy import Sample
from stillpoint.operators import allocate, merge, promote, propose, qa, segment, survive
from stillpoint.sources import png


def val(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r) if len(cols) > 1 else r[0]


def arr(*words):
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def test_dwell_ids(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 0b0000), ("v", 1, 0.5, 0b0001), ("v", 2, 1.0, 0b1111)], "video_id string, sample_idx int, ts double, dhash bigint")
    assert [r.dwell_id for r in segment.dwell_ids(df, 1).orderBy("sample_idx").collect()] == [0, 0, 1]


@pytest.mark.parametrize("jump, want", [(False, [(0, 7), (8, 12)]), (True, [(0, 5), (6, 7), (8, 12)])])
def test_coalesce_scenes(spark, jump, want):
    scenes = [(0, 5), (6, 7), (8, 12)]
    rows = [("v", k, s, e, float(s), float(e), (1 << 20) - 1 if jump and k == 1 else 0, (1 << 20) - 1 if jump and k == 1 else 0) for k, (s, e) in enumerate(scenes)]
    df = spark.createDataFrame(rows, "video_id string, scene_id int, s_idx int, e_idx int, s_ts double, e_ts double, s_hash bigint, e_hash bigint")
    got = segment.coalesce_scenes(df, 3.0, 18).orderBy("s_idx").collect()
    assert [(r.s_idx, r.e_idx) for r in got] == want


def test_allocation(spark):
    hashes = [7, 7, 7, 0, 255, 0, 255]
    df = spark.createDataFrame([("v", 0 if i < 3 else 1, i, h) for i, h in enumerate(hashes)], "video_id string, scene_id int, sample_idx int, dhash bigint")
    got = allocate.allocate(allocate.scene_novelty(df), F.lit(5)).orderBy("scene_id").collect()
    assert [r.alloc for r in got] == [1, 4]


def test_budgets(spark):
    budget = lambda b, s: allocate.candidate_budget(F.lit(b), F.lit(s))
    assert val(spark, budget(15, 49), budget(15, 20), budget(15, 10), budget(0, 10)) == [30, 20, 15, 0]
    assert val(spark, allocate.rescue_budget(F.lit(3), F.lit(990.0)), allocate.rescue_budget(F.lit(3), F.lit(49.0)), allocate.rescue_budget(F.lit(15), F.lit(10.0))) == [8, 3, 5]
    assert val(spark, allocate.rescue_ocr_cap(F.lit(3), F.lit(3), F.lit(1))) == 40


def test_markers(spark):
    a, b = arr("page", "2"), arr("page2")
    assert val(spark, ev.strict_markers(a)["page"], ev.strict_markers(b)["page"], ev.strict_markers(arr("2"))["page"]) == [["page2"], ["page2"], []]
    assert val(spark, ev.differing_evidence(arr("page1"), arr("page2")), ev.differing_evidence(arr("page1"), arr("x"))) == [True, False]
    assert val(spark, ev.marker_equivalent(a, b), ev.raw_markers(arr("pager", "optional"))["option"]) == [True, ["optional"]]


def test_sets(spark):
    assert val(spark, tk.jaccard(arr(), arr()), tk.jaccard(arr(), arr("a")), tk.jaccard(arr("a", "b"), arr("b", "c"))) == [1.0, 0.0, pytest.approx(1 / 3)]
    assert val(spark, tk.density_veto(arr("a", "b"), arr("a")), tk.density_veto(arr("a"), arr())) == [True, False]
    assert val(spark, tk.token_set(F.lit(" Größe!_a  b\tB, ")), tk.evidence_tokens(F.lit("Straße ./x-1/. --"))) == [["b", "größe_a"], ["strasse", "x-1"]]
    assert val(spark, tk.clean_tokens(arr("chrome", "draft", "page3", "abc123def0", "ok", "http://x")), tk.line_signatures(F.lit("a b\n\nA b\nc"))) == [["draft", "page3", "ok"], ["a b", "c"]]


def test_field_signatures(spark):
    got = val(spark, ev.field_signatures(F.lit("Status: Draft\nPage 3\nINVOICE SUMMARY\n2024-01-02"), arr()))
    kinds = {s.split(":")[0] for s in got}
    assert "status:draft" in got and "page:3" in got and "date:2024-01-02" in got
    assert {"label", "label-value", "heading"} <= kinds


def cands(spark, rows):
    full = [(r.get("v", "v"), r["i"], float(r["t"]), r.get("k", []), float(r.get("s", 0)), r.get("h"), r.get("sc"), r.get("r"), r.get("c"), r.get("m")) for r in rows]
    return spark.createDataFrame(full, "video_id string, sample_idx bigint, ts double, tokens array<string>, candidate_score double, dhash bigint, scene_id bigint, retention_reason string, caption string, content array<double>")


def test_near_time(spark):
    same = ["alpha", "beta", "gamma"]
    got = {r.sample_idx: r for r in survive.near_time_dedupe(cands(spark, [dict(i=10, t=95.49, k=same, s=1), dict(i=11, t=95.99, k=same, s=2)])).collect()}
    assert got[11].kept and not got[10].kept and got[11].merged_from_sample_idxs == [10, 11] and got[10].survivor_idx == 11


def test_global_by_hash(spark):
    got = {r.sample_idx: r for r in survive.global_dedupe(cands(spark, [dict(i=1, t=1, h=0, s=3), dict(i=2, t=100, h=0b11111, s=2), dict(i=3, t=200, h=1, s=1)])).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [True, True, False] and got[1].merged_from_sample_idxs == [1, 3]


def test_adjacent(spark):
    a = [f"w{i}" for i in range(12)]
    near = cands(spark, [dict(i=1, t=0, k=a[:11]), dict(i=2, t=76, k=a[1:])])
    far = cands(spark, [dict(i=1, t=0, k=a[:11]), dict(i=2, t=91.1, k=a[1:])])
    assert survive.adjacent_dedupe(near).where("kept").count() == 1
    assert survive.adjacent_dedupe(far).where("kept").count() == 2


def test_content_veto(spark):
    k = ["a", "b", "c"]
    rows = [dict(i=1, t=0, k=k, sc=1, m=[1.0, 1.0]), dict(i=2, t=1, k=k, sc=1, m=[2.0, 2.0]), dict(i=3, t=2, k=k, sc=2, m=[2.0, 2.0]), dict(i=4, t=3, k=[*k, "please", "selection"], sc=2, m=[2.0, 2.0])]
    got = {r.sample_idx: r.kept for r in survive.content_dedupe(cands(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_components_never_join_opposed_evidence(spark):
    rest = [f"w{i}" for i in range(20)]
    df = cands(spark, [dict(i=0, t=0, k=["page1", *rest]), dict(i=1, t=1, k=rest), dict(i=2, t=2, k=["page2", *rest])])
    verdicts = merge.pair_verdicts(df)
    got = [r.component for r in merge.merge_components(df, verdicts).orderBy("sample_idx").collect()]
    assert len(set(got)) == 2 and got[0] != got[2]


def test_output_cap(spark):
    df = cands(spark, [dict(i=i, t=i, k=["a"] * (i + 1), s=i) for i in range(4)])
    got = survive.output_cap(df.withColumn("tokens", F.expr("transform(tokens, (x, i) -> concat(x, i))")), 2)
    assert {r.sample_idx for r in got.where("not capped_out").collect()} == {2, 3} and got.first().cap_pressure == 2
    assert got.where("capped_out").count() == 2
    assert survive.output_cap(df, None).where("capped_out").count() == 0


def test_comparison_primaries(spark):
    base = spark.createDataFrame([("v", 5, 5.0, 1, 1), ("v", 20, 20.0, 2, 2), ("v", 40, 40.0, 3, 3)], "video_id string, sample_idx bigint, ts double, clip_cluster bigint, scene_id bigint")
    rescue = spark.createDataFrame([("v", 7, 7.0, 1, 2)], base.schema)
    assert {r.sample_idx for r in promote.comparison_primaries(rescue, base).collect()} == {5, 20}


def test_direct_beats_closer_lineage(spark):
    rows = spark.createDataFrame([("v", "s", 1, 12.0, [12.0, 10.1]), ("v", "s", 2, 30.0, [30.0])], "video_id string, stage string, sample_idx bigint, ts double, merged_timestamps array<double>")
    targets = spark.createDataFrame([("v", "a", 10.0, 2.25), ("v", "b", 29.0, 0.5)], "video_id string, label string, time_s double, tolerance double")
    got = {r.label: r for r in qa.nearest_in_stage(targets, rows).collect()}
    assert got["a"].matched_via == "timestamp" and got["a"].delta == 2.0
    assert not got["b"].hit and got["b"].matched_via == "none" and got["b"].sample_idx == 2


def test_fixture_check(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "member bigint, survivor bigint")
    survivors = spark.createDataFrame([(1,), (3,)], "sample_idx bigint")
    rules = [(1, "must_appear", 2, None, True), (2, "must_collapse", 1, 2, True), (3, "must_not_merge", 1, 2, True), (4, "must_select", 2, None, True), (5, "must_appear", 9, None, False)]
    got = qa.fixture_check(members, survivors, spark.createDataFrame(rules, "rule_no int, kind string, a bigint, b bigint, upstream boolean"))
    assert [r.status for r in got.orderBy("rule_no").collect()] == ["PASS", "PASS", "FAIL", "FAIL", "UNRESOLVED_UPSTREAM"]


def test_average_linkage_against_brute_force():
    rng = np.random.RandomState(0)
    for n, k in ((6, 2), (9, 3), (12, 4)):
        x = rng.normal(size=(n, 5))
        u = x / np.linalg.norm(x, axis=1)[:, None]
        groups = [[i] for i in range(n)]
        while len(groups) > k:
            pairs = [(np.mean([1 - u[a] @ u[b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j]
            _, i, j = min(pairs)
            groups[i] += groups.pop(j)
        got = propose.average_linkage(x, k)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in range(k)} == {frozenset(g) for g in groups}


def sample(rng, i):
    words = ["page1", "page2", "page", "2", "option1", "draft", "approved", "please", "selection", "01jan2024", "a", "b", "c", "d", "date", "error"]
    return Sample(i, i * 0.5, frozenset(rng.sample(words, rng.randint(0, 8))), rng.choice([0.0, 1.0, 2.0]), rng.choice([None, 0, 1, 255]), rng.choice(["", "a dialog", "a screenshot"]), rng.choice(["none", "differing_evidence"]))


def test_expressions_and_sets_agree(spark):
    """The column forms and the set forms of the evidence rules, on random pairs."""
    rng = random.Random(5)
    pairs = [(sample(rng, 0), sample(rng, 1)) for _ in range(300)]
    df = spark.createDataFrame([(k, sorted(a.tokens), sorted(b.tokens), a.protected or b.protected, a.caption, b.caption) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>, p boolean, ca string, cb string")
    A, B = F.col("a"), F.col("b")
    got = df.select("k", ev.differing_evidence(A, B).alias("d"), tk.density_veto(A, B).alias("v"), tk.jaccard(A, B).alias("j"), ev.form_state_delta(A, B).alias("f"), ev.merge_policy(A, B, F.col("p"), F.col("ca"), F.col("cb"), 0.5)["ok"].alias("m")).collect()
    for r in got:
        a, b = pairs[r.k]
        assert r.d == policy.evidence_differs(a, b) and r.v == policy.density_veto(a.tokens, b.tokens) and r.j == pytest.approx(policy.jaccard(a.tokens, b.tokens)) and r.f == policy.form_changed(a.tokens, b.tokens)
        if a.tokens and b.tokens:
            assert r.m == policy.may_merge(a, b, 0.5)


def test_legacy_lane_against_plain_python(spark):
    rng = random.Random(3)
    rows = [("v", i, float(i), round(rng.random(), 3), i // 30, (i % 30) // 10, True, 5, 20, 0.7) for i in range(90)]
    df = spark.createDataFrame(rows, "video_id string, sample_idx bigint, ts double, proxy_content_score double, scene_id bigint, temporal_window_id bigint, eligible boolean, rescue_budget int, legacy_cap int, tau_proxy double")
    got = [r.sample_idx for r in propose.legacy_lane(df).orderBy("pos").collect()]
    ranked = sorted(rows, key=lambda r: (-r[3], r[2], r[1]))
    want = [r[1] for r in ranked if r[3] >= 0.7][:5]
    groups = {}
    for r in ranked:
        groups.setdefault((r[4], r[5]), []).append(r)
    for g in sorted(groups.values(), key=lambda g: (-g[0][3], -len(g))):
        taken = []
        for r in g:
            if len(taken) < 3 and len(want) < 20 and r[1] not in want and all(abs(r[2] - t) >= 2.25 for t in taken):
                want.append(r[1])
                taken.append(r[2])
    assert got == want[:20]


def test_png_and_hash():
    rng = np.random.RandomState(1)
    for shape in ((5, 7), (6, 4, 3)):
        p = rng.randint(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(p)).reshape(shape) == p).all()
    ramp = np.tile(np.arange(64)[::-1], (48, 1)).astype(np.float64)
    assert pixels.difference_hash(ramp) == (1 << 64) - 1
    with pytest.raises(ValueError):
        pixels.difference_hash(ramp, 0)
    flat = np.full((2, 90, 160), 10.0)
    m = pixels.frame_metrics(flat)
    assert m["dark"].tolist() == [1, 1] and m["edge"].tolist() == [0, 0] and m["entropy"].tolist() == [0, 0] and m["sharpness"].tolist() == [0, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "video_id string, sample_idx bigint, ts double, tokens array<string>, candidate_score double, dhash bigint, scene_id bigint, caption string, retention_reason string, cluster_role string, clip_cluster bigint")
    assert survive.near_time_dedupe(none).count() == 0
    assert survive.retain_alternates(none).count() == 0
    assert merge.merge_components(none, merge.pair_verdicts(none)).count() == 0
    assert segment.dwell_ids(none).count() == 0
