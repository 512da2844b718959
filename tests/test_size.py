"""What only shows at size: joins that gather a table at the driver, pairs of large recordings, ties in floating point."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import duckdb
import pytest

from stillpoint.functions import policy
from stillpoint.operators import merge, promote, segment
from stillpoint.plans import queries as plans
from stillpoint.sources import views


@pytest.mark.parametrize("name", ["additive_promotion", "promotion_preflight", "promotion_reason", "swap_promotion"])
def test_no_broadcast(spark, sf, name):
    """Tables that grow with the input are merged, however small Spark takes their files for."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lists_are_made_after_the_shuffle(spark, sf):
    """Rows meet by recording as short columns; their tokens stand above the windows in the plan."""
    plan = views.candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("array_sort") < plan.index("Window")


def test_swaps_in_one_pass_over_the_view(spark, sf):
    """Each table is read once, and a recording's rows meet once, for both promotions; no group goes to a worker of its own."""
    plan = plans.QUERIES["swap_promotion"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("hashpartitioning(video_id") == 1 and "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_near_pairs_by_wide_buckets(spark):
    """Pairs in time, at the edges of buckets, before 0 and far out, of known and unknown scenes: each once."""
    rng, reach = random.Random(5), promote.TOLERANCE
    times = [k * reach for k in range(-9, 10)] + [rng.uniform(-20, 20) for _ in range(60)] + [1e9 + k * reach / 3 for k in range(12)]
    rows = [(n, t, rng.choice([None, 0, 1])) for n, t in enumerate(times)] + [(500, None, 0)]
    side = lambda name: spark.createDataFrame([("v", *x) for x in rows], f"video_id string, {name}_idx long, {name}_ts double, {name}_scene_id long")
    got = promote._near(side("r"), side("c"), "video_id", reach)
    want = sorted((i, j) for i, t, s in rows for j, u, q in rows if t is not None and u is not None and s == q and abs(u - t) <= reach)
    assert sorted((x.r_idx, x.c_idx) for x in got.select("r_idx", "c_idx").collect()) == want and len(want) > 200
    assert "explode(sequence(" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sets():
    """Two recordings of token sets: crowds, near copies, empty ones, one without a set, and sizes far apart."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    out = []
    for video in ("v", "w"):
        base = [sorted(rng.sample(words, k)) for k in (1, 2, 5, 20, 60, 200)]
        rows = [base[n % 6] if n % 4 == 0 else sorted({*base[n % 6], *rng.sample(words, n % 9)} - {*rng.sample(words, 90)}) for n in range(150)]
        out += [(video, n, r) for n, r in enumerate([*rows, [], [], None])]
    return out


def pairs_of(sets):
    return [(v, i, j, a, b) for (v, i, a), (w, j, b) in combinations(sets, 2) if v == w]


def test_density_is_counted_without_pairs(spark, sf, sets):
    df = spark.createDataFrame([*sets, ("alone", 0, ["a"])], "video_id string, sample_idx int, tokens array<string>")
    want = defaultdict(lambda: [0, 0])
    for v, _, _, a, b in pairs_of(sets):
        want[v][0] += 1
        want[v][1] += policy.density_veto(frozenset(a or ()), frozenset(b or ()))
    assert {r.video_id: [r.pairs, r.vetoed] for r in merge.density_vetoes(df).collect()} == want
    assert "Join" not in plans.QUERIES["density_veto"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("budget", [20_000, 1_600_000])
def test_all_alike_pairs(spark, sets, budget):
    """Tiles of few samples and of all give the pairs that plain Python gives."""
    df = spark.createDataFrame(sets, "video_id string, sample_idx int, tokens array<string>")
    want = {(v, i, j): x for v, i, j, a, b in pairs_of(sets) if a is not None and b is not None and (x := policy.jaccard(frozenset(a), frozenset(b))) >= 0.3}
    got = merge.jaccard_join(df, 0.3, budget=budget).collect()
    assert len(got) == len(want) > 1000 and {(r.video_id, r.i, r.j): r.jaccard for r in got} == want


def test_threshold_to_the_last_bit(spark):
    """A delta one bit from the quantile: found at 6,000,000 events, where two numbers interpolated otherwise fell on its other side."""
    values = [
        66.29, 14.12, 8.97, 14.17, 10.2, 32.71, 15.32, 115.5, 46.1, 41.94, 83.78, 93.1, 19.54, 11.57, 12.56, 12.16, 25.53, 17.4, 65.21, 68.12, 2.62, 13.31, 30.29, 11.84, 7.5, 6.73, 18.17, 19.31, 37.24,
        71.53, 57.78, 0.13, 7.56, 3.99, 51.28, 71.22, 3.54, 34.01, 34.08, 22.45, 24.35, 34.0, 19.63, 5.31, 57.99, 0.64, 42.97, 1.27, 70.3, 0.87, 102.04, 175.22, 22.67, 3.75, 70.78, 18.61, 44.16,
    ]
    rows = spark.createDataFrame([("v", n, v) for n, v in enumerate(values)] + [("still", n, 1.0) for n in range(3)], "video_id string, sample_idx int, v double")
    got = {(r.video_id, r.sample_idx): r for r in segment.local_peaks(segment.neighbour_deltas(rows, "v"), "v").collect()}
    deltas = [x for n in range(1, len(values)) if (x := abs(values[n] - values[n - 1])) >= 3]
    want = duckdb.connect().execute("select quantile_cont(x, 0.7) from (select unnest(?::double[]) as x)", [deltas]).fetchall()[0][0]
    assert {r.threshold for (v, _), r in got.items() if v == "v"} == {want} and not got["v", 55].local_peak
    assert got["still", 1].threshold is None and not got["still", 1].local_peak
