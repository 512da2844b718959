"""Operators on whole tables: joins, searches, packing, classifier, surrogates and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import zip_longest

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stillpoint.llm import ann, bpe, components, jaccard_join, packing, pii, quality, secret_scan
from stillpoint.llm.jaccard_join import Rule
from stillpoint.scratch import Scratch


def brute_components(rows, k, percent):
    """{id: (set size, least id of the component)} by an inverted index over all pairs that share a shingle."""

    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    each = [(i, sets(t)) for i, t in rows]
    up = list(range(len(each)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for p, (i, s) in enumerate(each):
        both = Counter(q for x in s for q in where[x])
        for q, n in both.items():
            if 100 * n >= percent * (len(s) + len(each[q][1]) - n):
                up[find(p)] = find(q)
        for x in s:
            where[x].append(p)
    least = {}
    for p, (i, _) in enumerate(each):
        least[find(p)] = min(least.get(find(p), i), i)
    return {i: (len(s), least[find(p)]) for p, (i, s) in enumerate(each)}


def near_copies(seed=4):
    """Chains and crowds of near copies, so that components are larger than links."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for size, edits in ((40, 2), (25, 6), (30, 4)):
        text = [word() for _ in range(80)]
        for k in range(size):
            own = list(text)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            if k % 5 == 4:
                text = own  # the next ones are copied from this one
            rows.append((i, " ".join(own)))
            i += 1
    rows += [(i + k, " ".join(word() for _ in range(rng.randint(0, 12)))) for k in range(40)]
    rows += [(i + 40 + k, "a very common line stands here") for k in range(12)]
    return rows


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(4, 85, block=8, pivots=2, pairs_up_to=2), Rule(5, 80, block=8, pivots=1, pairs_up_to=2), Rule(4, 85, block=8, wide=8, pivots=1, pairs_up_to=2, heavy=9), Rule(5, 80, block=6, wide=5, pivots=1, pairs_up_to=2, heavy=2), Rule(4, 100, block=4, wide=3, pivots=1, heavy=3)])
def test_jaccard_near_copies(spark, rule):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"), rule).collect()}
    assert got == brute_components(rows, rule.shingle, rule.percent)


def test_jaccard_bands():
    """Sets that may link lie in the same size band or in the next one."""
    import math

    for percent in (50, 80, 85, 99):
        rule = Rule(4, percent)
        band = lambda n: math.floor(math.log(n) / math.log(100 / rule.percent) + 1e-9)  # noqa: E731, B023
        assert all(abs(band(r) - band(s)) <= 1 for r in range(1, 300) for s in range(r, 601) if rule.may_differ(r, s) >= 0)


def test_jaccard_unlinked_group(spark):
    """Many texts share a passage that is most of each, but not enough to link them, and a few are linked."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, passage + " " + " ".join(word() for _ in range(8 + i % 20))) for i in range(90)]
    rows += [(200 + i, rows[i][1] + " " + word()) for i in range(0, 90, 9)]
    for rule in (Rule(4, 85, block=8, wide=7, pivots=1, pairs_up_to=2, sketch_bits=8), Rule(4, 85, block=8, wide=7, pivots=1, pairs_up_to=2, sketch_bits=8, heavy=20)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"), rule).collect()}
        want = brute_components(rows, 4, 85)
        assert got == want and len({c for _, c in want.values()}) > 50


def test_jaccard_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op5_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_twin(spark, duck, sf, tmp_path):
    """The SQL twin on the table, and on chains and crowds of near copies with texts without words."""
    got = {tuple(r) for r in jaccard_join.op5_ngram_jaccard_join(spark, sf).collect()}
    assert got == set(duck.sql(jaccard_join.OP5_SQL).fetchall())
    rows = [*near_copies(), (900, None), (901, ""), (902, " \t "), (903, "A b"), (904, "a B"), (905, "x\u00a0y \u00c4 z")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d/documents.parquet")
    got = {tuple(r) for r in jaccard_join.op5_ngram_jaccard_join(spark, f"{tmp_path}/d").collect()}
    other = duckdb.connect()
    other.sql(f"create view documents as select * from '{tmp_path}/d/documents.parquet/*.parquet'")
    assert got == set(other.sql(jaccard_join.OP5_SQL).fetchall()) and len({c for _, _, c in got}) < len(rows)


def test_jaccard_odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 1), (5, long, 2), (3, long + " end", 3), (None, long, 4), (7, None, 5), (8, "", 6), (9, "one  two\tthree", 7), (2, "ONE two Three", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(df, Rule(4, 85)).collect()), key=str)
    want = [(5, 3, 3), (5, 3, 3), (5, 29_997, 3), (3, 29_998, 3), (None, 29_997, None), (7, 0, 7), (8, 0, 8), (9, 1, 2), (2, 1, 2)]
    assert got == sorted(want, key=str)
    assert jaccard_join.join_components(df.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(df, Rule(4, 85))
    assert sorted(((r.doc_id) for r in kept.collect()), key=str) == sorted([2, 3, 7, 8, None], key=str) and kept.columns == df.columns


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint")
    got = {r.id: r.label for r in components.components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in up}


# Nearest neighbours


def brute_nearest(ids, x, q, k=5):
    n = np.sqrt((x * x).sum(1))
    at = int(np.flatnonzero(ids == q)[0])
    s = (x * x[at]).sum(1) / (n * n[at])
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return ids[order].tolist(), s[order].tolist()


@pytest.mark.parametrize("table, index", [("/root/testdata/sf0.1", ann.Index(block=256, queries=7)), ("/root/testdata/check_s", ann.Index())])
def test_nearest_recall(spark, table, index):
    """At two sizes, with a share of the entries visited that falls, recall stays over 0.9, and every score is exact."""
    df = spark.read.parquet(f"{table}/embeddings.parquet")
    t = df.toPandas().dropna().sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(np.float64)
    assert index.entries(len(ids)) < (0.38 if len(ids) < 3000 else 0.25) * len(ids)
    got = ann.search(df, F.col("id") % 50 == 0, index=index).toPandas()
    hit = total = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == [1, 2, 3, 4, 5]
        want, scores = brute_nearest(ids, x, q)
        hit += len(set(want) & set(rows.vec_id))
        total += 5
        exact = dict(zip(*brute_nearest(ids, x, q, len(ids) - 1), strict=True))
        assert np.allclose(rows.score, [exact[i] for i in rows.vec_id], atol=1e-12)
    print(f"recall {hit / total:.3f} of {len(ids)} vectors, {index.entries(len(ids))} visited")
    assert total == 5 * (ids % 50 == 0).sum() and hit / total >= 0.9


def test_nearest_with_all_in_reach(spark):
    """With all entries in reach the search is exact."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    t = df.toPandas().sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(np.float64)
    got = ann.search(df, F.col("id") % 50 == 0, index=ann.Index(reach=1e9, block=32, queries=3)).toPandas()
    for q, rows in got.groupby("query_id"):
        assert rows.sort_values("rank").vec_id.tolist() == brute_nearest(ids, x, q)[0]


def test_nearest_of_repeated_ids(spark):
    """Every row is an entry; an id is as near as its nearest row; lengths are searched each on its own."""
    rows = [(50, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (100, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 1.0]), (5, [2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in ann.search(df, F.col("id") % 50 == 0, index=ann.Index(reach=1e9)).collect()}
    assert got == {(50, 1): (1, 0.995037), (50, 2): (2, 0.894427), (50, 3): (3, 0.0), (100, 1): (4, 0.707107)}


def test_nearest_ties_and_odd_vectors(spark):
    v = [1.0, 0.0, 0.5, 0.5]
    rows = [(i, v) for i in range(0, 60)] + [(100, None), (150, []), (200, [0.0] * 4), (250, [float("nan"), 1.0, 0.0, 0.0]), (300, [1.0, None, 0.0, 0.0]), (350, [1.0, 2.0]), (None, v), (400, [0.0, 1.0, 0.0, 0.0]), (400, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id bigint, embedding array<double>, id int")
    got = ann.search(df, F.col("id") % 50 == 0, index=ann.Index(block=8, queries=2)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 400: [0, 1, 2, 3, 4]}
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_walk_visits_cells_by_distance():
    rng = np.random.RandomState(3)
    d1, d2, held = rng.rand(6), rng.rand(5), rng.randint(0, 4, 30)
    got, far = ann.walk(d1, d2, held, int(held.sum()))
    total = (d1[:, None] + d2[None, :]).reshape(-1)
    assert got == [c for c in np.argsort(total) if held[c]] and far == total[got[-1]]
    part, far = ann.walk(d1, d2, held, 9)
    assert part == got[: len(part)] and held[part].sum() >= 9 > held[part[:-1]].sum() and far == total[part[-1]]


# Packing


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = np.random.RandomState(seed)
    n = int(rng.choice([1, 40, 3000]))
    sizes = [np.clip(np.exp(rng.normal(6.3, 1.1, n)).astype(int), 1, 4096), rng.randint(1, 4097, n), rng.randint(1400, 2100, n), np.full(n, 4096)][seed % 4]
    histogram = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = min((packing.Plan(histogram, groups=g) for g in packing.GROUPS), key=lambda p: p.sequences)
    rank = np.zeros(n, np.int64)
    seen = Counter()
    for i, s in enumerate(sizes.tolist()):
        rank[i] = seen[s]
        seen[s] += 1
    sequence, offset = plan.place(sizes.astype(np.int64), rank)
    end = {}
    for i in np.lexsort((offset, sequence)):
        assert offset[i] == end.get(sequence[i], 0)
        end[sequence[i]] = offset[i] + sizes[i]
    assert max(end.values()) <= 4096 and len(end) == plan.sequences
    # first-fit decreasing is no better
    room, used = [], 0
    for s in sorted(sizes.tolist(), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(4096 - s)
            used += 1
        else:
            room[k] -= s
    assert plan.sequences <= max(used * 1.04, used + 1)


def check_packing(spark, rows, got):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            cut = ids[a : a + 4096]
            want[(i, p, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    return len(by), sum(r.length for r in got)


def test_packing_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, total = check_packing(spark, rows, packing.op4_best_fit_packing(spark, sf).collect())
    assert used <= -(-total // 4096) + 2


def test_packing_odd(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "same"), (3, "same"), (4, "word " * 9000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, rank int, length int")
    check_packing(spark, rows, packing.pack(df).collect())
    assert packing.pack(df.limit(0)).count() == 0


# Quality


def test_quality_held_out(spark):
    """Fitted on half of the labels, nearly all good texts of the other half stay and nearly all bad ones go."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = [r.doc_id in kept for r in held if r.quality == 1], [r.doc_id in kept for r in held if r.quality == 0]
    assert np.mean(good) >= 0.995 and np.mean(bad) <= 0.03


def test_kth_key_and_sample(spark):
    rng = np.random.RandomState(1)
    keys = np.concatenate([rng.normal(size=400), np.full(50, 0.25), [1e6, -1e6]])
    table = spark.createDataFrame([(float(x),) for x in keys], "_sample_key double")
    for k in (1, 7, 100, 180, 451, 452, 500):
        want = np.sort(keys)[::-1][k - 1] if k < len(keys) else -np.inf
        assert (keys >= quality.kth_key(table, k)).sum() == (keys >= want).sum()
    assert quality.kth_key(table, 0) == np.inf and quality.kth_key(table.limit(0), 3) == -np.inf


def test_ratio_against_plain_counts():
    make = quality.Grams(50, 2)
    texts = ["One two two", "three THREE three!", ""]
    bucket, owner = make(texts)
    assert Counter(owner.tolist()) == {0: 5, 1: 5}
    model = quality.Resampler(np.bincount(bucket, minlength=50).astype(float), np.bincount(bucket[owner == 0], minlength=50).astype(float))
    s = model.scores(texts, make)
    assert s[0] > 0 > s[1] and s[2] == 0


def test_quality_against_plain_python(spark, sf):
    """Weights of all texts and the ids sampled, by plain loops over words; the noise is Spark's."""
    M = 2**64 - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & M
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & M
        return h ^ h >> 31

    p = [int(x) for x in quality.PLACES]

    def buckets(text):
        words = (text or "").encode().split()
        forms = [re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[0-9]", b"9", w))), flags=re.S)[:8] + b"%d" % (min(len(w), 16) // 4) for w in words]
        again = [sum(2**lag for lag in (1, 2, 3) if i >= lag and words[i] == words[i - lag]) for i in range(len(words))]
        x = [mixed(xxhash.xxh64_intdigest(f) + a * p[5] & M) for f, a in zip(forms, again, strict=True)]
        y = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
        return [h % quality.BUCKETS for g in (x, y) for h in [*g, *(mixed(a * p[0] + b * p[1] & M) for a, b in zip(g, g[1:], strict=False))]]

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [(r.doc_id, buckets(r.text)) for r in docs.select("doc_id", "text").collect()]
    raw, target = Counter(b for _, bs in rows for b in bs), Counter(b for i, bs in rows if i in good for b in bs)
    n, m, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = {b: math.log((target[b] + 1) / (m + size)) - math.log((raw[b] / n * m + 1) / (m + size)) for b in raw}
    weight = {i: sum(ratio[b] for b in bs) for i, bs in rows}
    noise = {r.doc_id: r.x for r in docs.select("doc_id", quality._noise(F.col("doc_id"), 17).alias("x")).collect()}
    for options, k in (({}, None), ({"k": 60}, 60), ({"share": 0.5}, round(len(rows) / 2)), ({"k": 60, "temperature": 40.0}, 60)):
        if k is None:
            level = np.quantile([weight[i] for i in good if i in weight], quality.MISSED) - quality.MARGIN
            k = sum(w >= level for w in weight.values())
        key = {i: w + options.get("temperature", 1.0) * noise[i] for i, w in weight.items()}
        least = sorted(key.values(), reverse=True)[k - 1] if k < len(key) else -math.inf
        got = {r.doc_id: r for r in quality.resample(docs, labels, **options).collect()}
        assert set(got) == {i for i, v in key.items() if v >= least - 1e-9}
        assert all(abs(r.log_weight - weight[i]) < 1e-6 and abs(r.sample_key - key[i]) < 1e-6 for i, r in got.items())


def test_noise_changes_the_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = {}
    for t in (0.0, 40.0):
        model, table, _ = quality.train(docs, labels, k=80, temperature=t)
        told[t] = quality.noise_share(model, table)
    assert told[0.0] == 0 < told[40.0]


def test_quality_odd(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "Some good text stands here.", 2), (3, "Another good text.", 3), (3, "Another good text.", 3), (4, "word " * 40_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _noise int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (4, None), (2, 0)], "doc_id bigint, quality int")
    assert quality.resample(df, labels.limit(0)).count() == 6
    kept = quality.keep_good(df.drop("_noise"), labels)
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id = 3").count() == 2
    assert quality.resample(df.limit(0), labels).count() == 0


# Surrogates

FOUND = {
    "email": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+\.[a-z]+",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])",
    "card": r"(?<!\d)\d{16}(?!\d)",
    "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}",
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_surrogates_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pii.op8_pii_surrogates(spark, sf).collect()}
    assert set(got) == set(docs)
    told, n = {}, 0
    originals = {m for t in docs.values() for p in FOUND.values() for m in re.findall(p, t)}
    for i, t in docs.items():
        new = got[i].text
        if not got[i].n_entities:
            assert new == t
        for kind, p in FOUND.items():
            before, after = re.findall(p, t), re.findall(p, new)
            assert len(before) == len(after)
            for a, b in zip(before, after, strict=True):
                n += 1
                assert a != b and b not in originals and told.setdefault((kind, a), b) == b
                if kind == "card" and luhn(a):
                    assert luhn(b)
                if kind == "ip":
                    assert all(0 < int(x) < 255 for x in b.split("."))
    assert n > 20
    by_kind = Counter(k for k, _ in told)
    assert all(len({v for (k, _), v in told.items() if k == kind}) == c for kind, c in by_kind.items())


def test_surrogates_types(spark):
    text = "Mr. John Smith met Mrs Anna Lee and Господин Иванов Пётр; mail A.b@Mail.example.com or a.B@mail.example.com, 4111 1111 1111 1111, 4111111111111111, (555) 123-4567, 123-45-6789. Mr. John Smith left."
    df = spark.createDataFrame([(1, text), (2, "Mr. John Smith"), (3, None), (4, ""), (None, "x@y.com"), (2, "Mr. John Smith")], "doc_id bigint, text string")
    rows = pii.surrogates(df).collect()
    new = next(r for r in rows if r.doc_id == 1)
    assert new.n_entities == 10
    him = re.findall(r"Mr\. (\w+) (\w+)", new.text)
    assert len(set(him)) == 1 and him[0][0] in pii.NAMES["latin", "m"].split() and re.search(r"Mrs (\w+) ", new.text)[1] in pii.NAMES["latin", "f"].split()
    assert re.search(r"Господин (\w+) ", new.text)[1] in pii.NAMES["cyrillic", "m"].split()
    mails = re.findall(r"\S+@\S+\.com", new.text)
    assert len(set(mails)) == 1 and "example" not in mails[0]
    a, b = re.search(r"\d{4} \d{4} \d{4} \d{4}", new.text)[0], re.search(r"(?<!\d)\d{16}(?!\d)", new.text)[0]
    assert a.replace(" ", "") == b and luhn(b) and b[0] == "4" and re.search(r"\(\d{3}\) \d{3}-\d{4}", new.text) and re.search(r"\d{3}-\d{2}-\d{4}", new.text)
    same = {r.text for r in rows if r.doc_id == 2}
    assert same == {f"Mr. {him[0][0]} {him[0][1]}"} and len(rows) == 6
    assert [r.text for r in rows if r.doc_id in (3, 4)] in ([None, ""], ["", None])
    assert pii.surrogates(df.limit(0)).count() == 0
    assert pii.surrogates(df, key=pii.Key("other")).where("doc_id = 2").first().text not in same


def test_surrogates_whole_names(spark):
    names = ["Mr. John Paul Smith", "Mr McDonald", "Dr O'Neil", "Dr O’Neil", "Mr J. Smith", "Mr J.R. Smith", "Mr J Smith", "Mrs Anna Maria de", "Ms Mary-Jane O'Hara Smith"]
    df = spark.createDataFrame([(i, f"Then {n} left, and so on.") for i, n in enumerate(names)], "doc_id bigint, text string")
    for r in pii.surrogates(df).collect():
        assert r.n_entities == 1 and r.text.endswith((" left, and so on.", " de left, and so on.")) and re.fullmatch(r"Then (Mr\.?|Dr|Mrs|Ms) \w+([ -]\w+)?( de)? left, and so on\.", r.text)
        assert not re.search("John|Paul S|Smith|Donald|Neil|Jane|Hara", r.text)


def test_surrogates_of_other_formats(spark):
    df = spark.createDataFrame([(1, "Mr Smith"), (2, "Mr. Smith"), (3, "Dr. J.R. Smith"), (4, "Dr J. R. Smith"), (5, "a.b@mail.example.com"), (6, "A.B@MAIL.EXAMPLE.COM")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.surrogates(df).collect()}
    assert got[2] == got[1].replace("Mr ", "Mr. ") and got[3] == got[4].replace("Dr ", "Dr. ")
    assert got[6] == got[5].upper() and got[5] == got[5].lower()


def test_surrogate_collisions_are_settled(spark):
    """Eight one-digit entities share ten surrogates: many collide, all end up different and none is an entity."""
    found = spark.createDataFrame([("ssn", f"{i}") for i in range(5)], "kind string, norm string")
    got = pii.entity_table(found, pii.Key("k", 200), Scratch(spark, "t")).collect()
    assert len(got) == 5 and len({r.surrogate for r in got}) == 5 and not {r.surrogate for r in got} & {r.norm for r in got}


def plain_permuted(values, many, tag):
    """The permutation in plain Python."""

    def number(*x):
        return int(hashlib.sha256("\x1f".join(x).encode()).hexdigest()[:12], 16)

    def shifted(x, of, by, sign, what):
        d = hashlib.sha256("\x1f".join([tag, what, ",".join(map(str, by))]).encode()).hexdigest()
        return [(v + sign * (number(d, str(i)) % m)) % m for i, (v, m) in enumerate(zip(x, of, strict=True))]

    a, b, p, q = values[::2], values[1::2], many[::2], many[1::2]
    for k in range(pii.ROUNDS):
        a, b, p, q = b, shifted(a, p, b, 1, str(k)), q, p
    step = lambda x, of, side: [(v + 1 + number(tag, f"step{side}", str(i)) % max(m - 1, 1)) % m for i, (v, m) in enumerate(zip(x, of, strict=True))]
    a, b = step(a, p, "a"), step(b, q, "b")
    for k in reversed(range(pii.ROUNDS)):
        a, b, p, q = shifted(b, q, a, -1, str(k)), a, q, p
    return [x for pair in zip_longest(a, b) for x in pair if x is not None]


def plain_entities(text):
    """(kind, start, end) of the entities of a text, with another engine of regular expressions."""
    return [(next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m[0])), *m.span()) for m in regex.finditer(pii.ENTITY, text)] if text else []


def test_surrogates_against_plain_python(spark):
    """Every text of sf0.01: what is found, and that all else stays; e-mail addresses, phones and IPv4 addresses to the letter."""
    key, d = pii.Key("twin"), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {i: plain_entities(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in pii.surrogates(docs, key=key).collect()}
    table = {(r.kind, r.norm): r for r in pii.with_format(spark.createDataFrame(sorted({(k, texts[i][a:b].lower() if k == "email" else re.sub("[ ().-]", "", texts[i][a:b]) if k != "ip" else texts[i][a:b]) for i, f in found.items() for k, a, b in f}), "kind string, norm string")).collect()}
    told, exact = {}, 0
    for i, t in texts.items():
        assert got[i].n_entities == len(found[i])
        at = 0
        new, out = got[i].text, 0
        for k, a, b in found[i]:
            assert new[out : out + a - at] == t[at:a]
            out += a - at
            one = new[out : out + b - a] if k != "ip" else re.match(r"[0-9.]+", new[out:])[0].rstrip(".")
            out, at = out + len(one), b
            assert told.setdefault((k, t[a:b]), one) == one != t[a:b]
            if k in ("email", "phone", "ip"):
                norm = t[a:b].lower() if k == "email" else re.sub("[ ().-]", "", t[a:b]) if k == "phone" else t[a:b]
                r = table[k, norm]
                values = plain_permuted([p.value for p in r._p], [p.many for p in r._p], "\x1f".join(["twin", r._format, "0"]))
                want = "".join(chr(p.base + v) for p, v in zip(r._p, values, strict=True)) if k != "ip" else ".".join(str(p.base + v) for p, v in zip(r._p, values, strict=True))
                top = re.search(r"\.[a-z]+$", norm)[0] if k == "email" else ""
                have = re.sub("[^a-z0-9]", "", one.removesuffix(top)) if k == "email" else re.sub("[^0-9]", "", one)[-len(want) :] if k == "phone" else one
                exact += have == want
                assert have == want
        assert new is None and t is None or new[out:] == t[at:]
    assert exact > 20 and len({(k, v) for (k, _), v in told.items()}) == len(told) and not {v for _, v in told.items()} & {m for _, m in told}


@pytest.mark.parametrize("head, again, tail, n", [
    ("x a@b", ".a", " y", 0), ("", "a", "@b.com", 1), ("", "a.", "", 0), ("", "a'", "a@b.com", 1), ("", "@a", "", 0), ("x@", "a-", "b.com", 1), ("a@", "𝒜a", ".com", 1), ("x@y", ".com", "", 1),
    ("Mr ", "John ", "", 1), ("Mr ", "J. ", "X", 1), ("Mr A ", "de ", "", 1), ("Mr A", "-Bc", "", 1), ("Mr ", "O'Brien'", "", 1), ("Mr ", "Ab", "", 1), ("", "1", "", 0), ("", "1 ", "", 0), ("", "1.", "", 0),
    ("", "1-", "", 0), ("", "a:", "", 0), ("", ":", "", 0), ("", "(555) ", "", 0), ("DE89 ", "X", "", 0), ("", "MrA ", "", 0), ("Mr", " ", "X", 0),
])
def test_surrogates_long_repeats(spark, head, again, tail, n):
    """No repeated part of a pattern overflows the stack, or takes quadratic time."""
    df = spark.createDataFrame([(1, head + again * 10**6 + tail)], "doc_id bigint, text string")
    assert pii.with_entities(df, "text").select(F.size("_entities")).first()[0] == n


def test_surrogates_of_small_formats(spark):
    """One-letter addresses: 200 of 676 leave room to avoid the originals, 500 don't; all surrogates differ."""
    every = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    for n in (200, 500):
        own = every[:n]
        df = spark.createDataFrame([(i, f"to {own[i % n]} now") for i in range(1000)], "doc_id bigint, text string")
        got = {(own[r.doc_id % n], r.text.split()[1]) for r in pii.surrogates(df, key=pii.Key("k")).collect()}
        assert len(got) == n == len({b for _, b in got}) and all(a != b and re.fullmatch("[a-z]@[a-z].co", b) for a, b in got)
        assert n == 500 or not {b for _, b in got} & set(own)


def test_surrogates_of_people(spark):
    """One surname however it is addressed; titles without gender take that of other mentions; given names of one surname differ."""
    names = ["Mr Smith", "Mr. Smith", "Dr Smith", "Mr. John Smith", "Dr. John Smith", "MR SMITH", "Dr Anna Smith", "Mrs Anna Smith", "Mr\nSmith"]
    crowd = [f"Mr {a}{b} Miller" for a in ("Abel", "Bert", "Carl", "Dan", "Ed", "Frank", "Gus", "Hal") for b in ("", "o", "as", "in", "us")]
    df = spark.createDataFrame(list(enumerate(names + crowd)), "doc_id bigint, text string")
    got = [r.text for r in pii.surrogates(df).orderBy("doc_id").collect()]
    smith = got[0].split()[1]
    assert got[1] == f"Mr. {smith}" and got[2] == f"Dr {smith}" and got[5] == f"MR {smith.upper()}" and got[8] == f"Mr\n{smith}" and smith != "Smith"
    assert got[3].removeprefix("Mr. ") == got[4].removeprefix("Dr. ") and got[6].removeprefix("Dr ") == got[7].removeprefix("Mrs ")
    assert got[6].split()[1] in pii.NAMES["latin", "f"].split()
    assert len(set(got[len(names) :])) == len(crowd) and all(set(x.split()[1].split("-")) <= set(pii.NAMES["latin", "m"].split()) for x in got[len(names) :])


def test_surrogates_keep_checks(spark):
    def iban_ok(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    mails = ["x" * 80 + "@y.com", "josé@bücher.example", "o'brien@x.com", "x@y.com-", "用户@例子.中国"]
    texts = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:DB8::1", "+49 170 1234567", "0.0.0.0", *mails]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in pii.surrogates(df).orderBy("doc_id").collect()]
    assert got[0] == got[1].replace(" ", "") and [iban_ok(x) for x in got[:4]] == [True, True, True, False] and got[0][:2] == "DE" and len(got[1]) == len(texts[1])
    assert re.fullmatch("[0-9a-f:]{39}", got[4]) and re.fullmatch("[0-9A-F]{4}:[0-9A-F]{3}::[0-9]", got[5]) and got[6].startswith("+49 ") and got[7] == "0.0.0.0"
    for a, b in zip(mails, got[8:], strict=True):
        assert len(a) == len(b) and a.split("@")[0] != b.split("@")[0] and a[-3:] == b[-3:] and "xxxx" not in b


def test_surrogates_need_the_secret(spark):
    df = spark.createDataFrame([(1, "a.person@example.com")], "doc_id bigint, text string")
    assert pii.surrogates(df).first().text == pii.surrogates(df).first().text != pii.surrogates(df, key=pii.Key("a")).first().text
    spark.conf.set("spark.stillpoint.pii.secret", "a")
    try:
        assert pii.session_key(spark) == pii.Key("a")
    finally:
        spark.conf.unset("spark.stillpoint.pii.secret")


def test_surrogates_plan_is_native(spark, sf):
    plan = pii.op8_pii_surrogates(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scratch = Scratch(spark, "test")
    one = scratch.save(corpus_pipeline.quality_stage(spark, docs, sf))
    kept = {r.doc_id: r.text for r in one.collect()}
    want = {r.doc_id for r in quality.resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(kept) == want and one.columns == docs.columns and 0 < len(kept) < len(texts)
    two = scratch.save(corpus_pipeline.jaccard_stage(spark, one, sf))
    groups = brute_components(list(kept.items()), 5, 80)
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in groups.items() if c == i} and two.columns == docs.columns
    three = scratch.save(corpus_pipeline.secrets_stage(spark, two, sf))
    for r in three.collect():
        spans = secret_scan.find_secrets(kept[r.doc_id])
        assert (r.text == kept[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
    four = corpus_pipeline.packing_stage(spark, three, sf).collect()
    check_packing(spark, [(r.doc_id, r.text) for r in three.collect()], four)
    assert len(four) == corpus_pipeline.run(spark, sf).count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "best-fit packing"]
