"""Registered queries do the whole job: every recording and every pair, against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import pytest

from stillpoint.functions import policy
from stillpoint.plans import queries as plans
from stillpoint.sources import views

FINAL, PASS1, SAMPLED = "survival.final_post_cap", "proposal.pass1_primary", "sampling"


@pytest.fixture(scope="module")
def nearest(spark, sf):
    """The nearest row of each recording, wanted time and stage: (rank, delta, seen, sample_idx)."""
    samples = defaultdict(list)
    for r in views.samples(spark, sf).collect():
        samples[r.video_id].append((r.sample_idx, r.ts))
    targets = views.targets(spark, sf).collect()
    every = {SAMPLED: (1, ()), PASS1: (4, ()), FINAL: (8, (6.0,))}
    out = {}
    for video, rows in samples.items():
        for t in targets:
            for stage, (k, later) in every.items():
                times = [(x, i, via) for i, ts in rows if i % k == 0 for x, via in ((ts, 0), (ts, 1), *((ts + s, 1) for s in later))]
                out[video, t.label, stage] = min((via if abs(x - t.time_s) <= t.tolerance else 2, abs(x - t.time_s), x, i) for x, i, via in times)
    return out


def test_recall_of_every_recording(spark, sf, nearest):
    got = plans.QUERIES["qa_recall"](spark, sf).collect()
    assert len(got) == len(nearest)
    for r in got:
        rank, delta, _, i = nearest[r.video_id, r.label, r.stage]
        assert (r.hit, r.matched_via, r.sample_idx) == (rank < 2, ("timestamp", "merged_timestamps", "none")[rank], i) and abs(r.delta - delta) < 1e-5


def test_bucket_of_every_recording(spark, sf, nearest):
    want = {}
    for video, label, _ in nearest:
        final, first, sampled = (nearest[video, label, s][0] for s in (FINAL, PASS1, SAMPLED))
        bucket = "hit_direct" if final == 0 else "hit_lineage_only" if final == 1 else "coarse_proposal_exists_but_not_selected" if first < 2 else "sampled_but_no_proposal_near_target" if sampled < 2 else "no_sample_near_target"
        want[video, label] = (bucket, "final" if final < 2 else "pass1" if first < 2 else "sampling_only" if sampled < 2 else "none")
    got = plans.QUERIES["qa_bucket"](spark, sf).collect()
    assert len(got) == len(want) and {(r.video_id, r.label): (r.bucket, r.best_family) for r in got} == want


def test_totals_of_every_recording(spark, sf, nearest):
    n = Counter((stage, x[0]) for (_, _, stage), x in nearest.items())
    got = {r.stage: (r.direct, r.lineage_only, r.miss) for r in plans.QUERIES["qa_totals"](spark, sf).collect()}
    assert got == {s: tuple(n[s, k] for k in range(3)) for s in (SAMPLED, PASS1, FINAL)}


def test_verdicts_of_every_pair(spark, sf):
    recordings = defaultdict(list)
    for r in views.candidates(spark, sf).collect():
        recordings[r.video_id].append(policy.Sample(r.sample_idx, r.ts, frozenset(r.tokens)))

    def verdict(a, b):
        if policy.evidence_differs(a, b):
            return "ocr-evidence"
        if policy.jaccard(a.tokens, b.tokens) < 0.75:
            return "ocr-jaccard"
        if policy.density_veto(a.tokens, b.tokens):
            return "ocr-density"
        return "time-transcript" if b.ts - a.ts > 30 else "merge"

    assert all(len(s.tokens) >= 3 for rows in recordings.values() for s in rows)
    want, far = {}, Counter()
    for video, rows in recordings.items():
        for a, b in combinations(sorted(rows, key=lambda s: s.idx), 2):
            want[video, a.idx, b.idx] = (verdict(a, b), round(policy.jaccard(a.tokens, b.tokens), 6))
            far[want[video, a.idx, b.idx][0]] += b.ts - a.ts > 5
    assert far["merge"] and far["time-transcript"]
    got = plans.QUERIES["pair_verdicts"](spark, sf).collect()
    assert len(got) == len(want)
    assert {(r.video_id, r.i, r.j): (r.reason, round(r.jaccard, 6)) for r in got} == want
