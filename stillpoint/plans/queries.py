"""Queries of the operators over the views, with parameters that suit the tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import hashing, tokens
from ..operators import allocate, attribution, merge, promote, propose, qa, segment, survive, transcript
from ..scratch import Scratch
from ..sources import views
from ..sources.views import V1, V2, V3, V4, V5, V6
from .sqltext import LIST, raw_sql, strict_sql, tokens_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


# Sampling, hashes, dwells and scenes


@query(f"with {V1} select video_id, frame_idx, row_number() over (partition by video_id order by frame_idx) - 1 as sample_idx from v1 where frame_idx % 3 = 0")
def sample_every_k(spark, d):
    return segment.sample_every(views.samples(spark, d), 3).select("video_id", "frame_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"))


@query(f"with {V2} select video_id, sample_idx, dhash, lower(lpad(hex(dhash), 16, '0')) as dhash_hex from v2")
def dhash_bits(spark, d):
    return views.features(spark, d).select("video_id", "sample_idx", "dhash", hashing.hash_hex(F.col("dhash")).alias("dhash_hex"))


@query(f"with {V2} select video_id, sample_idx, bit_count(xor(dhash, lag(dhash) over (partition by video_id order by sample_idx)))::int as distance from v2")
def hamming_neighbors(spark, d):
    w = Window.partitionBy("video_id").orderBy("sample_idx")
    return views.features(spark, d).select("video_id", "sample_idx", hashing.hamming(F.col("dhash"), F.lag("dhash").over(w)).cast("int").alias("distance"))


_DWELL = f"""{V2}, jump as (select *, coalesce((bit_count(xor(dhash, lag(dhash) over (partition by video_id order by sample_idx))) > 31)::int, 0) as j from v2),
dwell as (select *, (sum(j) over (partition by video_id order by sample_idx))::bigint as dwell_id from jump)"""


def _dwells(spark, d):
    return segment.dwell_ids(views.features(spark, d), 31)


@query(f"with {_DWELL} select video_id, sample_idx, dwell_id from dwell")
def dwell_segments(spark, d):
    return _dwells(spark, d).select("video_id", "sample_idx", "dwell_id")


@query(f"with {_DWELL}, s as (select *, round(list_dot_product(embedding[1:8]::double[], embedding[9:16]::double[]), 6) as score from dwell) select video_id, dwell_id, max(row(score, sample_idx))[2] as sample_idx, max(score) as score, count(*) as samples from s group by all")
def dwell_representative(spark, d):
    """The sample that stands for each stable stretch: the best by a score, the later of equals."""
    rows = _dwells(spark, d).withColumn("candidate_score", r6(hashing.dot(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)))).withColumn("sharpness", F.lit(0.0))
    return propose.cluster_best(rows, cluster="dwell_id").select("video_id", "dwell_id", "sample_idx", F.col("candidate_score").alias("score"), F.col("clip_cluster_size").alias("samples"))


_SCENES = f"""{V1}, cut as (select *, coalesce((abs(v - lag(v) over (partition by video_id order by sample_idx)) > 60)::int, 0) as c from v1),
scened as (select *, (sum(c) over (partition by video_id order by sample_idx))::bigint as scene_id from cut),
ranges as (select video_id, scene_id, min(sample_idx) as s_idx, max(sample_idx) as e_idx, arg_min(ts, sample_idx) as s_ts, arg_max(ts, sample_idx) as e_ts, arg_min(frame_idx * 2654435761 % 1048576, sample_idx) as s_hash, arg_max(frame_idx * 2654435761 % 1048576, sample_idx) as e_hash from scened group by all)"""


def _scened(spark, d):
    return segment.scene_cuts(views.samples(spark, d), "v", 60)


def _ranges(spark, d):
    rows = _scened(spark, d).withColumn("dhash", F.col("frame_idx") * 2654435761 % 1048576)
    return segment.scene_ranges(rows, hash_col="dhash")


@query(f"with {_SCENES} select video_id, scene_id, s_idx, e_idx, round(s_ts, 6) as s_ts, round(e_ts, 6) as e_ts from ranges")
def scene_cuts(spark, d):
    return _ranges(spark, d).select("video_id", "scene_id", "s_idx", "e_idx", r6("s_ts").alias("s_ts"), r6("e_ts").alias("e_ts"))


_COALESCED = f"""{_SCENES}, brk as (select *, case when lag(s_idx) over w is null or e_ts - s_ts >= 3 or coalesce(bit_count(xor(lag(e_hash) over w, s_hash)), 10) >= 10 then 1 else 0 end as b from ranges window w as (partition by video_id order by s_idx, e_idx)),
grp as (select *, (sum(b) over (partition by video_id order by s_idx, e_idx))::bigint - 1 as g from brk)"""


@query(f"with {_COALESCED} select video_id, g as scene_id, min(s_idx) as s_idx, max(e_idx) as e_idx, count(*) as merged from grp group by all")
def scene_coalesce(spark, d):
    return segment.coalesce_scenes(_ranges(spark, d), 3.0, 10)


_WSEC = f"""{_SCENES}, gap as (select *, ts - lag(ts) over (partition by video_id order by ts) as gap from scened),
wsec as (select video_id, greatest(20.0::double, 8.0::double * coalesce(median(gap) filter (where gap > 0), 0.5::double)) as window_seconds from gap group by all)"""


@query(f"with {_WSEC} select video_id, round(window_seconds, 6) as window_seconds from wsec")
def window_seconds(spark, d):
    return segment.window_seconds(views.samples(spark, d)).select("video_id", r6("window_seconds").alias("window_seconds"))


_WIN = f"""{_WSEC}, win as (select s.*, window_seconds, floor(greatest(0, ts - min(ts) over (partition by video_id, scene_id)) / window_seconds)::bigint as temporal_window_id from scened s join wsec using (video_id))"""


def _windowed(spark, d):
    rows = _scened(spark, d)
    return segment.window_ids(rows.join(segment.window_seconds(rows), "video_id"), F.col("window_seconds"))


@query(f"with {_WIN} select video_id, sample_idx, scene_id, temporal_window_id from win")
def window_ids(spark, d):
    return _windowed(spark, d).select("video_id", "sample_idx", "scene_id", "temporal_window_id")


@query(f"""with {_SCENES}, mid as (select video_id, scene_id, s_idx, e_idx from ranges) select v1.video_id, sample_idx, max(scene_id) as scene_id from v1 left join mid on v1.video_id = mid.video_id and sample_idx between s_idx and e_idx group by all""")
def scene_of_sample(spark, d):
    return segment.samples_in_scenes(views.samples(spark, d), _ranges(spark, d)).select("video_id", "sample_idx", "scene_id")


@query(f"""with {V1}, t as (select video_id, min(ts) + 10 as a, max(ts) - 10 as b from v1 group by all), last as (select video_id, max(sample_idx) as l from v1 group by all)
select t.video_id, least(coalesce(min(sample_idx) filter (where ts >= a), any_value(l)), any_value(l)) as s_idx, greatest(least(coalesce(min(sample_idx) filter (where ts >= a), any_value(l)), any_value(l)), coalesce(max(sample_idx) filter (where ts <= b), 0)) as e_idx from t join v1 using (video_id) join last using (video_id) group by all""")
def scene_from_times(spark, d):
    rows = views.samples(spark, d)
    times = rows.groupBy("video_id").agg((F.min("ts") + 10).alias("start"), (F.max("ts") - 10).alias("end"))
    return segment.scenes_from_times(times, rows).select("video_id", F.col("s_idx").cast("bigint").alias("s_idx"), F.col("e_idx").cast("bigint").alias("e_idx"))


# Budgets

_NOVEL = f"""{V2}, sc as (select *, sample_idx // 7 as scene_id from v2), st as (select *, bit_count(xor(dhash, lag(dhash) over (partition by video_id, scene_id order by sample_idx))) as dist from sc),
nov as (select video_id, scene_id, count(*) as n, coalesce(avg(dist), 0) as novelty from st group by all)"""


def _novelty(spark, d):
    return allocate.scene_novelty(views.features(spark, d).withColumn("scene_id", F.floor(F.col("sample_idx") / 7)))


@query(f"with {_NOVEL} select video_id, scene_id, n, round(novelty, 6) as novelty from nov")
def scene_novelty(spark, d):
    return _novelty(spark, d).withColumn("novelty", r6("novelty"))


@query(f"""with {_NOVEL}, a as (select *, count(*) over p as k from nov window p as (partition by video_id)),
b as (select *, greatest(15, least(k, 30)) as total, case when sum(novelty) over p <= 0 then greatest(1, n)::double else novelty end as w from a window p as (partition by video_id)),
c as (select *, case when total < k then 0 else 1 end as base from b), e as (select *, greatest(0, total - sum(base) over p) * w / sum(w) over p as raw, greatest(0, total - sum(base) over p) as rest from c window p as (partition by video_id)),
f as (select *, floor(raw)::bigint as extra, rest - sum(floor(raw)) over p as left_over from e window p as (partition by video_id))
select video_id, scene_id, (base + extra + (row_number() over (partition by video_id order by raw - extra desc, w desc, scene_id) <= left_over)::int)::bigint as alloc from f""")
def cluster_allocation(spark, d):
    rows = _novelty(spark, d)
    total = allocate.candidate_budget(F.lit(15), F.count("*").over(Window.partitionBy("video_id")))
    return allocate.allocate(rows, total).select("video_id", "scene_id", "alloc")


_ELIGIBLE = f"""{_WIN}, norm as (select *, case when max(v) over p = min(v) over p then 0 else (v - min(v) over p) / (max(v) over p - min(v) over p) end as proxy_content_score, sample_idx % 5 <> 0 as eligible from win window p as (partition by video_id)),
lim0 as (select video_id, max(ts) - min(ts) as dur, count(distinct case when eligible then concat(scene_id, ':', temporal_window_id) end) as windows, count(distinct case when eligible then scene_id end) as scenes, quantile_cont(proxy_content_score, 0.75) as tau_proxy from norm group by all),
lim1 as (select *, greatest(3, 5, least(8, ceil(dur / 90))::bigint) as rescue_budget from lim0),
lim as (select *, least(96, greatest(4 * rescue_budget, 2 * windows + scenes, 40)) as ocr_cap, least(60, 4 * rescue_budget) as legacy_cap from lim1)"""


def _eligible(spark, d):
    rows = _windowed(spark, d).withColumn("proxy_content_score", segment.min_max(F.col("v"), "video_id")).withColumn("eligible", F.col("sample_idx") % 5 != 0)
    return rows, allocate.rescue_limits(rows, 15)


@query(f"with {_ELIGIBLE} select video_id, rescue_budget, windows, scenes, ocr_cap, legacy_cap, round(tau_proxy, 6) as tau_proxy from lim")
def rescue_budget(spark, d):
    _, limits = _eligible(spark, d)
    return limits.select("video_id", *(F.col(c).cast("bigint").alias(c) for c in ("rescue_budget", "windows", "scenes", "ocr_cap", "legacy_cap")), r6("tau_proxy").alias("tau_proxy"))


# Neighbours, peaks, scores

_DELTA = f"""{_ELIGIBLE}, delta as (select *, coalesce(abs(v - lag(v) over o), 0) as prev_delta, coalesce(abs(lead(v) over o - v), 0) as next_delta from norm window o as (partition by video_id order by sample_idx))"""


@query(f"with {_DELTA} select video_id, sample_idx, round(prev_delta, 6) as prev_delta, round(next_delta, 6) as next_delta from delta")
def prev_next_delta(spark, d):
    return segment.neighbour_deltas(views.samples(spark, d), "v").select("video_id", "sample_idx", r6("prev_delta").alias("prev_delta"), r6("next_delta").alias("next_delta"))


_PEAK = f"""{_DELTA}, thr as (select video_id, greatest(3, quantile_cont(prev_delta, 0.7)) as threshold from delta where prev_delta >= 3 group by all),
peak as (select d.*, threshold, coalesce(abs(proxy_content_score - lag(proxy_content_score) over (partition by d.video_id order by sample_idx)), 0) as band_change,
coalesce(prev_delta >= threshold and prev_delta >= next_delta, false) as local_peak, coalesce(prev_delta >= threshold and next_delta <= greatest(2, 0.6 * prev_delta), false) as settled from delta d left join thr using (video_id))"""


def _peaks(spark, d):
    rows, limits = _eligible(spark, d)
    return segment.local_peaks(segment.neighbour_deltas(rows, "v"), "proxy_content_score").join(limits, "video_id")


@query(f"with {_PEAK} select video_id, sample_idx, local_peak, settled, round(band_change, 6) as band_change from peak")
def local_peaks(spark, d):
    return _peaks(spark, d).select("video_id", "sample_idx", "local_peak", "settled", r6("band_change").alias("band_change"))


@query(f"""with {V2}, n as (select *, coalesce(lag(dhash) over o, dhash) as l, coalesce(lead(dhash) over o, dhash) as r from v2 window o as (partition by video_id order by sample_idx)) select video_id, sample_idx, case when greatest(bit_count(xor(dhash, l)), bit_count(xor(dhash, r))) <= 31 then 1.0::double else 0.0::double end as end_of_dwell_bonus from n""")
def dwell_bonus(spark, d):
    return segment.dwell_bonus(views.features(spark, d), 31).select("video_id", "sample_idx", "end_of_dwell_bonus")


@query(f"with {V1} select video_id, sample_idx, round(least(v * 10 / 1000, 1.5) + 0.75 * least(greatest(v / 100, 0), 1) + 0.5 * (sample_idx % 2), 6) as score from v1")
def rep_score(spark, d):
    return views.samples(spark, d).select("video_id", "sample_idx", r6(segment.representative_score(F.col("v") * 10, F.col("v") / 100, (F.col("sample_idx") % 2).cast("double"))).alias("score"))


@query(f"""with {_ELIGIBLE} select video_id, sample_idx, round(proxy_content_score, 6) as normal, round(least(greatest(0.45 * proxy_content_score + 0.30 * (1 - proxy_content_score) + 0.25 * (proxy_content_score - (0.5 * greatest(0, proxy_content_score - 0.7) + 0.5 * greatest(0, 0.9 - proxy_content_score - 0.7))), 0), 1), 6) as proxy from norm""")
def minmax_proxy_score(spark, d):
    x = segment.min_max(F.col("v"), "video_id")
    rows = views.samples(spark, d).withColumn("x", x)
    p = F.col("x")
    return rows.select("video_id", "sample_idx", r6("x").alias("normal"), r6(segment.proxy_score(p, 1 - p, p, p, 0.9 - p)).alias("proxy"))


@query(f"""with {V1}, b as (select video_id, floor(v / 8) as b, count(*) as c from v1 group by all), p as (select *, c / sum(c) over (partition by video_id) as p from b) select video_id, count(*) as buckets, round(sum(-p * log2(p)), 6) as entropy from p group by all""")
def entropy_buckets(spark, d):
    return segment.bucket_entropy(views.samples(spark, d), "v", 8.0).withColumn("entropy", r6("entropy"))


@query(f"with {V1}, n as (select *, ts - lag(ts) over o <= 2 as close, kind = lag(kind) over o as alike from v1 window o as (partition by video_id order by sample_idx)) select video_id, count(close) as pairs, round(avg(case when close is not null then (close and alike)::int end), 6) as redundancy from n group by all")
def adjacent_redundancy(spark, d):
    w = Window.partitionBy("video_id").orderBy("sample_idx")
    rows = views.samples(spark, d).withColumn("close", F.col("ts") - F.lag("ts").over(w) <= 2).withColumn("alike", F.col("kind") == F.lag("kind").over(w))
    return segment.redundancy(rows, F.col("close"), F.col("alike")).withColumn("redundancy", r6("redundancy"))


# Vectors and clusters


@query(f"with {V2} select video_id, sample_idx, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as length, round(embedding[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as first_component from v2")
def embedding_norm(spark, d):
    return views.features(spark, d).select("video_id", "sample_idx", F.round(hashing.norm(F.col("embedding")), 5).alias("length"), F.round(hashing.unit(F.col("embedding"))[0], 5).alias("first_component"))


@query(f"with {V2} select a.video_id, a.sample_idx as i, b.sample_idx as j, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 5) as cosine from v2 a join v2 b on a.video_id = b.video_id and a.sample_idx < b.sample_idx where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.30")
def cosine_pairs(spark, d):
    pairs = merge.pairs_within(views.features(spark, d), cols=("embedding",)).withColumn("cosine", hashing.dot(F.col("a_embedding"), F.col("b_embedding")))
    return pairs.where(F.col("cosine") >= 0.30).select("video_id", "i", "j", F.round("cosine", 5).alias("cosine"))


_CLUSTER = f"{V2}, cl as (select *, frame_idx % 5 as clip_cluster, round(embedding[1]::double, 5) as candidate_score, round(1 + embedding[2]::double, 5) as sharpness from v2), best as (select video_id, clip_cluster, max(row(candidate_score, sample_idx, sharpness)) as b, count(*) as size from cl group by all)"


def _clusters(spark, d):
    rows = views.features(spark, d).withColumn("clip_cluster", F.col("frame_idx") % 5)
    return rows.withColumn("candidate_score", F.round(F.col("embedding")[0].cast("double"), 5)).withColumn("sharpness", F.round(1 + F.col("embedding")[1].cast("double"), 5))


@query(f"with {_CLUSTER} select video_id, clip_cluster, b[2] as sample_idx, b[1] as candidate_score, size as clip_cluster_size from best")
def cluster_best(spark, d):
    return propose.cluster_best(_clusters(spark, d)).select("video_id", "clip_cluster", "sample_idx", "candidate_score", "clip_cluster_size")


@query(f"""with {_CLUSTER}, bb as (select video_id, clip_cluster, cl.sample_idx as best_idx, cl.sharpness as bs, dhash as bh, embedding as be from best join cl using (video_id, clip_cluster) where cl.sample_idx = b[2]),
p as (select cl.*, best_idx, cl.sharpness / greatest(bs, 1e-9) as ratio, bit_count(xor(dhash, bh)) as hd, 1 - list_dot_product(be::double[], embedding::double[]) as cd from cl join bb using (video_id, clip_cluster) where cl.sample_idx <> best_idx)
select video_id, clip_cluster, best_idx, max(row(candidate_score, sample_idx))[2] as alt_idx, max_by(case when hd >= 34 then 'dhash' else 'clip' end, row(candidate_score, sample_idx)) as reason from p where ratio >= 0.5 and (hd >= 34 or cd > 0.95) group by all""")
def cluster_alt(spark, d):
    return propose.cluster_alternates(_clusters(spark, d), hash_distance=34, clip_distance=0.95).select("video_id", "clip_cluster", "best_idx", "alt_idx", "reason")


@query(f"with {_CLUSTER} select video_id, clip_cluster as scene_id, arg_max(sample_idx, row(sharpness, -sample_idx)) as sample_idx, max(sharpness) as sharpness from cl group by all")
def sharpest_of_scene(spark, d):
    return propose.sharpest(_clusters(spark, d).withColumn("scene_id", F.col("clip_cluster"))).select("video_id", "scene_id", "sample_idx", "sharpness")


@query()
def scene_clustering(spark, d):
    """Average linkage within scenes; tests hold it against brute force."""
    rows = views.features(spark, d).withColumn("scene_id", F.floor(F.col("sample_idx") / 20)).withColumn("alloc", F.lit(4))
    return propose.cluster_scenes(rows)


# Tokens


_TOK = tokens_sql("ocr_text")


@query(f"with {V3} select video_id, sample_idx, array_to_string({_TOK}, ' ') as tokens from v3")
def doc_tokens(spark, d):
    return views.texts(spark, d).select("video_id", "sample_idx", F.array_join(tokens.token_set(F.col("ocr_text")), " ").alias("tokens"))


_DF = f"{V3}, tk as (select video_id, sample_idx, ocr_text, {_TOK} as toks from v3), ex as (select video_id, unnest(toks) as token from tk), dfq as (select video_id, token, count(*) as docs from ex group by all)"


def _frequency(spark, d):
    return attribution.document_frequency(views.texts(spark, d))


@query(f"with {_DF} select * from dfq")
def doc_frequency(spark, d):
    return _frequency(spark, d)


@query(f"""with {_DF}, n as (select video_id, count(*) as n from v3 group by all), w as (select video_id, sample_idx, unnest(list_filter(regexp_split_to_array(ocr_text, '\\s+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(regexp_split_to_array(ocr_text, '\\s+'), lambda x: x <> ''), 1) as pos from v3),
k as (select w.*, regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}_]', '', 'g') as t from w), kept as (select k.*, row_number() over (partition by k.video_id, sample_idx order by pos) as r from k left join dfq on k.video_id = dfq.video_id and t = token join n on n.video_id = k.video_id where coalesce(docs, 0) / n <= 0.5)
select v3.video_id, v3.sample_idx, coalesce(string_agg(word, ' ' order by pos) filter (where r <= 70), '') as filtered from v3 left join kept on v3.video_id = kept.video_id and v3.sample_idx = kept.sample_idx group by all""")
def df_filter(spark, d):
    return attribution.filter_frequent(views.texts(spark, d)).select("video_id", "sample_idx", F.col("filtered_text").alias("filtered"))


@query(f"""with {V3} select video_id, sample_idx, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(ocr_text, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_.-]', '', 'g')), lambda t: t <> '' and length(t) <= 48 and not starts_with(t, 'http') and not starts_with(t, 'www') and not contains(t, 'users') and not contains(t, 'downloads'))[1:120])), ' ') as tokens from v3""")
def rescue_tokens(spark, d):
    return views.texts(spark, d).select("video_id", "sample_idx", F.array_join(tokens.rescue_token_set(F.col("ocr_text")), " ").alias("tokens"))


_CLEAN = f"""list_filter(toks, lambda t: t <> '' and (t in {LIST(tokens.STATUS)} or regexp_matches(t, '{tokens.MARKER}') or not (t in {LIST(tokens.CHROME)} or (regexp_matches(t, '{tokens.UUIDISH}') and regexp_matches(t, '[0-9]')) or contains(t, 'users') or contains(t, 'downloads') or contains(t, 'http') or contains(t, 'www') or length(t) > 36)))"""


@query(f"with {V3}, tk as (select video_id, sample_idx, {_TOK} as toks from v3) select video_id, sample_idx, len(toks) as raw, len({_CLEAN}) as clean, round_even((len(toks) - len({_CLEAN})) / greatest(len(toks), 1), 4) as attrition from tk")
def clean_tokens(spark, d):
    rows = views.texts(spark, d).withColumn("toks", tokens.token_set(F.col("ocr_text"))).withColumn("cleaned", tokens.clean_tokens(F.col("toks")))
    raw, clean = F.size("toks").cast("bigint"), F.size("cleaned").cast("bigint")
    return rows.select("video_id", "sample_idx", raw.alias("raw"), clean.alias("clean"), F.bround((raw - clean) / F.greatest(raw, F.lit(1)), 4).alias("attrition"))


@query(f"""with {V3}, l as (select video_id, sample_idx, list_filter(list_transform(regexp_split_to_array(ocr_text, '\\r\\n|\\r|\\n'), lambda x: list_filter(list_transform(regexp_extract_all(replace(lower(x), 'ß', 'ss'), '[a-z0-9][a-z0-9._/-]*'), lambda t: regexp_replace(t, '[._/-]+$', '')), lambda t: t <> '')), lambda x: len(x) > 0)[1:80] as ls from v3),
s as (select video_id, sample_idx, list_transform(ls, lambda x: array_to_string(x[1:12], ' ')) as sig from l) select video_id, sample_idx, coalesce(array_to_string(list_filter(sig, lambda x, i: list_position(sig, x) = i), '|'), '') as signature from s""")
def line_signatures(spark, d):
    return views.texts(spark, d).select("video_id", "sample_idx", F.array_join(tokens.line_signatures(F.col("ocr_text")), "|").alias("signature"))


def _evidence_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[a-z0-9][a-z0-9._/-]*'), lambda t: regexp_replace(t, '[._/-]+$', '')), lambda t: t <> '')"


def _short_sql(prefix: str, tokens: str) -> str:
    return f"'{prefix}:' || substr(sha256(array_to_string({tokens}, ' ')), 1, 10)"


_VALUE = f"lambda t: t in {LIST(ev.VALUES)} or regexp_matches(t, '[0-9]')"
_VALUE_NAME = f"""lambda t: case when t in {LIST(ev.SIGNATURE_STATUS)} then 'status:' || t when regexp_matches(t, '^{ev.DATE_VALUE.replace(chr(92) + "b", "")}$') then 'date:' || t when starts_with(t, 'page') and length(t) > 4 then 'page:' || substr(t, 5) else {_short_sql('value', '[t]')} end"""
_REST = "list_transform(list_filter(own, lambda t: starts_with(t, '{0}') and length(t) > {1}), lambda t: '{0}:' || substr(t, {1} + 1))"


@query(f"""with {V3}, hay as (select *, lower(coalesce(ocr_text, '')) || ' ' || lower(array_to_string({_TOK}, ' ')) as hay from v3), own as (select *, {_evidence_sql('hay')} as own from hay),
whole as (select video_id, sample_idx, list_concat(list_transform(list_filter(own, lambda t: t in {LIST(ev.SIGNATURE_STATUS)}), lambda t: 'status:' || t), list_transform(regexp_extract_all(hay, '{ev.DATE_VALUE}'), lambda t: 'date:' || t), list_transform(regexp_extract_all(hay, '\\bpage\\s*([0-9]+[a-z]?)\\b', 1), lambda t: 'page:' || t),
{_REST.format('page', 4)}, {_REST.format('section', 7)}, list_transform(list_filter(own, lambda t: t in {LIST(ev.REFERENCES)}), lambda t: 'reference:' || t)) as found from own),
line as (select video_id, sample_idx, trim(unnest(regexp_split_to_array(coalesce(ocr_text, ''), '\r\n|\r|\n'))) as x from v3), said as (select *, {_evidence_sql('x')} as toks, regexp_matches(x, '[:=]') as stated from line),
side as (select *, case when stated then {_evidence_sql("regexp_extract(x, '^([^:=]*)', 1)")} else toks[:-2] end as label, case when stated then {_evidence_sql("regexp_extract(x, '^[^:=]*[:=](.*)$', 1)")} else toks[-1:] end as vals from said where len(toks) > 0),
part as (select *, list_transform(list_filter(vals, {_VALUE}), {_VALUE_NAME})[1:4] as names from side),
each as (select video_id, sample_idx, case when len(label) > 0 and len(names) > 0 then list_prepend({_short_sql('label', 'label[1:8]')}, list_transform(names, lambda v: 'label-value:' || substr(sha256(array_to_string(label[1:8], ' ')), 1, 10) || ':' || v)) when stated or (len(toks) >= 2 and len(names) > 0) then []
when len(toks) <= 8 and len(list_filter(toks, {_VALUE})) = 0 and length(x) <= 80 and len(regexp_extract_all(x, '\\p{{L}}')) > 0 and (len(regexp_extract_all(x, '\\p{{Lu}}')) >= 0.6 * len(regexp_extract_all(x, '\\p{{L}}')) or len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(1, len(toks) - 1)) then [{_short_sql('heading', 'toks[1:8]')}] else [] end as found from part),
every as (select video_id, sample_idx, unnest(found) as f from whole union select video_id, sample_idx, unnest(found) from each), named as (select video_id, sample_idx, string_agg(f, '|' order by f) as signature from every group by all)
select video_id, sample_idx, coalesce(signature, '') as signature from v3 left join named using (video_id, sample_idx)""")
def field_signatures(spark, d):
    """Names of stated fields."""
    return views.texts(spark, d).select("video_id", "sample_idx", F.array_join(ev.field_signatures(F.col("ocr_text"), tokens.token_set(F.col("ocr_text"))), "|").alias("signature"))


_PAIRS3 = f"{V3}, tk as (select video_id, sample_idx, {_TOK} as tokens from v3), pr as (select a.video_id, a.sample_idx as i, b.sample_idx as j, a.tokens as ta, b.tokens as tb from tk a join tk b on a.video_id = b.video_id and a.sample_idx < b.sample_idx)"
_JAC = "case when len(ta) = 0 and len(tb) = 0 then 1.0::double when len(ta) = 0 or len(tb) = 0 then 0.0::double else len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::double end"


def _token_sets(spark, d):
    """Null texts have no set."""
    return views.texts(spark, d).withColumn("tokens", F.when(F.col("ocr_text").isNotNull(), tokens.token_set(F.col("ocr_text"))))


@query(f"with {_PAIRS3} select video_id, i, j, round({_JAC}, 6) as jaccard from pr where {_JAC} >= 0.3")
def jaccard_pairs(spark, d):
    return merge.jaccard_join(_token_sets(spark, d), 0.3).select("video_id", "i", "j", r6("jaccard").alias("jaccard"))


@query(f"with {_PAIRS3} select video_id, count(*) as pairs, count_if(len(ta) > 0 and len(tb) > 0 and greatest(len(ta), len(tb)) >= 2 * least(len(ta), len(tb)) and len(list_filter(case when len(ta) >= len(tb) then ta else tb end, lambda x: not list_contains(case when len(ta) >= len(tb) then tb else ta end, x))) > 0) as vetoed from pr group by all")
def density_veto(spark, d):
    return merge.density_vetoes(_token_sets(spark, d))


# Evidence on candidates

_ADJ = f"{V4}, adj as (select *, lag(tokens) over (partition by video_id order by sample_idx) as prev from v4)"


def _adjacent(spark, d):
    w = Window.partitionBy("video_id").orderBy("sample_idx")
    return views.candidates(spark, d).withColumn("prev", F.lag("tokens").over(w))


_WITH_PREV = "prev is not null"


@query("with " + V4 + " select video_id, sample_idx, " + ", ".join(f"array_to_string({raw_sql(k, 'tokens')}, ' ') as {k}" for k in ev.KINDS) + " from v4")
def markers_raw(spark, d):
    m = ev.raw_markers(F.col("tokens"))
    return views.candidates(spark, d).select("video_id", "sample_idx", *(F.array_join(m[k], " ").alias(k) for k in ev.KINDS))


@query("with " + V4 + " select video_id, sample_idx, " + ", ".join(f"array_to_string({strict_sql(k, 'tokens')}, ' ') as {k}" for k in ev.KINDS) + " from v4")
def markers_canonical(spark, d):
    m = ev.strict_markers(F.col("tokens"))
    return views.candidates(spark, d).select("video_id", "sample_idx", *(F.array_join(m[k], " ").alias(k) for k in ev.KINDS))


_DIFFER = " or ".join(f"(len({raw_sql(k, '{a}')}) > 0 and len({raw_sql(k, '{b}')}) > 0 and {raw_sql(k, '{a}')} <> {raw_sql(k, '{b}')})" for k in ev.KINDS)


def differ_sql(a: str, b: str) -> str:
    return "(" + _DIFFER.replace("{a}", a).replace("{b}", b) + ")"


@query(f"with {_ADJ} select video_id, sample_idx, {differ_sql('prev', 'tokens')} as differs from adj where {_WITH_PREV}")
def differing_evidence(spark, d):
    return _adjacent(spark, d).where(_WITH_PREV).select("video_id", "sample_idx", ev.differing_evidence(F.col("prev"), F.col("tokens")).alias("differs"))


def _set_delta_sql(a: str, b: str) -> str:
    return f"(len(list_filter({a}, lambda x: not list_contains({b}, x))) + len(list_filter({b}, lambda x: not list_contains({a}, x))))"


def meaningful_sql(a: str, b: str) -> str:
    s = {k: (strict_sql(k, a), strict_sql(k, b)) for k in ev.KINDS}
    changed = {k: f"(len({x}) > 0 and len({y}) > 0 and {x} <> {y})" for k, (x, y) in s.items()}
    flips = " or ".join(f"((len({x}) > 0) <> (len({y}) > 0))" for x, y in s.values())
    count = " + ".join(f"{c}::int" for c in changed.values())
    return f"({s['status'][0]} <> {s['status'][1]} or {flips} or ({count}) >= 2 or (({' or '.join(changed[k] for k in ev.KINDS[:3])}) and {_set_delta_sql(a, b)} >= 3))"


@query(f"with {_ADJ} select video_id, sample_idx, {meaningful_sql('prev', 'tokens')} as keep_both from adj where {_WITH_PREV}")
def meaningful_retention(spark, d):
    return _adjacent(spark, d).where(_WITH_PREV).select("video_id", "sample_idx", ev.meaningful_for_retention(F.col("prev"), F.col("tokens")).alias("keep_both"))


def gain_sql(new: str, old: str) -> str:
    gained = f"list_filter({new}, lambda x: not list_contains({old}, x))"
    both = lambda t: f"(list_contains({t}, 'please') and list_contains({t}, 'selection'))"
    return f"(({both(new)} and not {both(old)}) or len(list_filter({gained}, lambda t: regexp_matches(t, '{ev.DATE_TOKEN}'))) > 0 or len(list_filter({gained}, lambda t: t in {LIST(ev.FORM_STATE)})) >= 2)"


@query(f"with {_ADJ} select video_id, sample_idx, {gain_sql('tokens', 'prev')} as gained, ({gain_sql('tokens', 'prev')} or {gain_sql('prev', 'tokens')} or len(list_filter(list_concat(list_filter(tokens, lambda x: not list_contains(prev, x)), list_filter(prev, lambda x: not list_contains(tokens, x))), lambda t: t in {LIST(ev.FORM_STATE)})) >= 2) as changed from adj where {_WITH_PREV}")
def form_state_delta(spark, d):
    return _adjacent(spark, d).where(_WITH_PREV).select("video_id", "sample_idx", ev.form_state_gain(F.col("tokens"), F.col("prev")).alias("gained"), ev.form_state_delta(F.col("tokens"), F.col("prev")).alias("changed"))


@query(f"with {V3}, tk as (select video_id, sample_idx, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(ocr_text, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_.-]', '', 'g')), lambda t: t <> '' and length(t) <= 48 and not starts_with(t, 'http') and not starts_with(t, 'www') and not contains(t, 'users') and not contains(t, 'downloads'))[1:120])) as t from v3) select video_id, sample_idx, len(list_filter(t, lambda x: x in {LIST(ev.SOURCES)} or regexp_matches(x, '[._-]'))) as refs from tk")
def content_refs(spark, d):
    return views.texts(spark, d).select("video_id", "sample_idx", F.size(ev.content_references(tokens.rescue_token_set(F.col("ocr_text")))).cast("bigint").alias("refs"))


def subsumes_sql(new: str, old: str) -> str:
    within = " and ".join(f"len(list_filter({strict_sql(k, old)}, lambda x: not list_contains({strict_sql(k, new)}, x))) = 0" for k in ev.KINDS)
    return f"(case when len({old}) = 0 then len({new}) > 0 else not {gain_sql(old, new)} and {within} and len(list_filter({old}, lambda x: not list_contains({new}, x))) = 0 and len(list_filter({new}, lambda x: not list_contains({old}, x))) > 0 end)"


@query(f"with {_ADJ} select video_id, sample_idx, {subsumes_sql('tokens', 'prev')} as subsumes from adj where {_WITH_PREV}")
def subsumes(spark, d):
    return _adjacent(spark, d).where(_WITH_PREV).select("video_id", "sample_idx", ev.strictly_subsumes(F.col("tokens"), F.col("prev")).alias("subsumes"))


def equivalent_sql(a: str, b: str) -> str:
    same = " and ".join(f"{strict_sql(k, a)} = {strict_sql(k, b)}" for k in ev.KINDS)
    some = " or ".join(f"len({strict_sql(k, a)}) > 0" for k in ev.KINDS)
    return f"(({some}) and {same})"


@query(f"with {_ADJ} select video_id, sample_idx, {equivalent_sql('prev', 'tokens')} as equivalent, ({equivalent_sql('prev', 'tokens')} and not {gain_sql('tokens', 'prev')}) as redundant from adj where {_WITH_PREV}")
def marker_equiv(spark, d):
    return _adjacent(spark, d).where(_WITH_PREV).select("video_id", "sample_idx", ev.marker_equivalent(F.col("prev"), F.col("tokens")).alias("equivalent"), ev.marker_redundant(F.col("tokens"), F.col("prev")).alias("redundant"))


@query(f"""with {V4}, h as (select video_id, sample_idx, tokens, lower(array_to_string(tokens, ' ')) || ' ' as h from v4) select video_id, sample_idx, case when contains(h, 'approve') or contains(h, 'approval') or contains(h, 'submit') or contains(h, 'confirm') then 'approval' when contains(h, 'table') or contains(h, 'row') or contains(h, 'column') or contains(h, 'spreadsheet') then 'table' when contains(h, 'form') or contains(h, 'field') or contains(h, 'input') or contains(h, 'dropdown') then 'form' when len(tokens) > 0 then 'text_screen' else 'visual' end as screen_type from h""")
def screen_type(spark, d):
    return views.candidates(spark, d).select("video_id", "sample_idx", ev.screen_type(F.col("tokens"), F.lit(None).cast("string")).alias("screen_type"))


_CAPTION = "array_to_string(tokens, ' ')"
_STRONG = " or ".join(f"contains(c, '{w}')" for w in ev.PROTECTIVE if w != "screenshot")


@query(f"with {V4}, h as (select video_id, sample_idx, {_CAPTION} as c from v4) select video_id, sample_idx, ({_STRONG} or contains(c, 'screenshot')) as protects, ({_STRONG}) as strongly from h")
def caption_predicates(spark, d):
    c = F.array_join("tokens", " ")
    return views.candidates(spark, d).select("video_id", "sample_idx", ev.caption_protects(c).alias("protects"), ev.caption_protects_strongly(c).alias("strongly"))


_HAS = lambda t: "(" + " or ".join(f"len({raw_sql(k, t)}) > 0" for k in ev.KINDS) + ")"


@query(f"""with {V4}, m as (select *, first_value(tokens) over (partition by video_id, scene_id order by case when cluster_role = 'primary' then 0 else 2 end, ts, sample_idx) as mt, first_value(sample_idx) over (partition by video_id, scene_id order by case when cluster_role = 'primary' then 0 else 2 end, ts, sample_idx) as mi from v4),
r as (select *, case when sample_idx = mi then 'primary' when cluster_role <> 'alt' then 'single_or_non_alt' when {differ_sql('mt', 'tokens')} then 'raw_differing_evidence' when {meaningful_sql('mt', 'tokens')} then 'meaningful_evidence_delta' when {_HAS('tokens')} and not {_HAS('mt')} then 'raw_evidence_asymmetry' end as candidate_reason from m)
select video_id, sample_idx, candidate_reason, case when candidate_reason in ('primary', 'single_or_non_alt') then 'none' when candidate_reason = 'raw_differing_evidence' then 'differing_evidence' else 'evidence_asymmetry' end as retention_reason from r where candidate_reason is not null""")
def retain_alternates(spark, d):
    rows = views.candidates(spark, d).withColumn("clip_cluster", F.col("scene_id").cast("bigint")).withColumn("caption", F.lit(None).cast("string"))
    return survive.retain_alternates(rows).select("video_id", "sample_idx", "candidate_reason", "retention_reason")


_METRIC = "sample_idx % 11 * 2.5::double as edge, sample_idx % 7 * 0.5::double as ent, sample_idx % 3 * 0.48::double as dark, (sample_idx + 1) % 4 * 0.31::double as bright, sample_idx % 5 * 4.0::double as sd"


@query(f"""with {V1}, m as (select *, {_METRIC}, case sample_idx % 4 when 0 then [] when 1 then ['a', 'b', 'c'] when 2 then ['page2'] else ['a'] end as tk, case sample_idx % 6 when 0 then 'a screenshot of a computer screen' when 1 then 'computer screen with a black background' when 2 then 'an approval dialog' else '' end as cap, sample_idx % 9 = 0 as prot from v1),
q as (select *, len(list_filter(tk, lambda t: starts_with(t, 'page'))) > 0 as evi, contains(cap, 'approval') or contains(cap, 'dialog') as strong, contains(cap, 'screenshot') or contains(cap, 'approval') as anycap from m)
select video_id, sample_idx, case when prot and (evi or strong) then 'protected_retained_evidence'
when (not evi and not strong and (contains(cap, 'screenshot of a computer screen') or contains(cap, 'black background')) and edge < 6 and ent < 2.2 and (bright > 0.6 or dark > 0.6)) or (not evi and not strong and contains(cap, 'black background') and edge < 8 and ent < 2.7 and dark > 0.2) or (len(tk) < 3 and not evi and not strong and dark > 0.95 and edge < 2 and ent < 1) then null
when len(tk) >= 3 or evi or anycap then 'text_or_protective_signal' when sd < 12 and (dark > 0.85 or bright > 0.92 or edge < 20) then null else 'visual_signal' end as reason from q
where (case when prot and (evi or strong) then 'k' when (not evi and not strong and (contains(cap, 'screenshot of a computer screen') or contains(cap, 'black background')) and edge < 6 and ent < 2.2 and (bright > 0.6 or dark > 0.6)) or (not evi and not strong and contains(cap, 'black background') and edge < 8 and ent < 2.7 and dark > 0.2) or (len(tk) < 3 and not evi and not strong and dark > 0.95 and edge < 2 and ent < 1) then null when len(tk) >= 3 or evi or anycap then 't' when sd < 12 and (dark > 0.85 or bright > 0.92 or edge < 20) then null else 'v' end) is not null""")
def low_info_filter(spark, d):
    i = F.col("sample_idx")
    rows = views.samples(spark, d)
    metrics = rows.select("video_id", "sample_idx", (i % 11 * 2.5).alias("edge"), (i % 7 * 0.5).alias("entropy"), (i % 3 * 0.48).alias("dark"), ((i + 1) % 4 * 0.31).alias("bright"), (i % 5 * 4.0).alias("stddev"))
    tk = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(i % 4 == 2, F.array(F.lit("page2"))).otherwise(F.array(F.lit("a")))
    cap = F.when(i % 6 == 0, "a screenshot of a computer screen").when(i % 6 == 1, "computer screen with a black background").when(i % 6 == 2, "an approval dialog").otherwise("")
    rows = rows.withColumn("tokens", tk).withColumn("caption", cap).withColumn("retention_reason", F.when(i % 9 == 0, "differing_evidence").otherwise("none"))
    return survive.drop_low_information(rows, metrics).select("video_id", "sample_idx", F.col("low_information_filter_reason").alias("reason"))


# Nearest, covered, redundant: rescue rows are every third candidate of a customer's first scenes

_RESCUE = f"{V4}, res as (select * from v4 where sample_idx % 3 = 2), cand as (select * from v4 where sample_idx % 3 <> 2)"


def _candidates_once(spark, d):
    """The view of candidates, written: queries that read it several times don't join it again."""
    return Scratch(spark, "candidates").save(views.candidates(spark, d))


def _split(spark, d):
    rows = _candidates_once(spark, d)
    return rows.where("sample_idx % 3 = 2"), rows.where("sample_idx % 3 <> 2")


@query(f"with {_RESCUE} select res.video_id, res.sample_idx, arg_min(cand.sample_idx, row(abs(cand.ts - res.ts), cand.ts)) as primary_idx, min(abs(cand.ts - res.ts)) as gap from res left join cand on res.video_id = cand.video_id and res.scene_id = cand.scene_id group by all")
def nearest_primary(spark, d):
    rescue, base = _split(spark, d)
    return promote.nearest_primary(rescue, base).select("video_id", "sample_idx", "primary_idx", "gap")


@query(f"with {_RESCUE} select res.video_id, res.sample_idx, min(case when res.scene_id = cand.scene_id then abs(cand.ts - res.ts) end) as scene_gap, min(abs(cand.ts - res.ts)) as any_gap from res left join cand on res.video_id = cand.video_id group by all")
def same_scene_gap(spark, d):
    rescue, base = _split(spark, d)
    finite = lambda c: F.when(F.col(c) < float("inf"), F.col(c)).alias(c)
    return promote.same_scene_gap(rescue, base).select("video_id", "sample_idx", finite("scene_gap"), finite("any_gap"))


_NEAR = "res.video_id = cand.video_id and res.scene_id is not distinct from cand.scene_id and abs(cand.ts - res.ts) <= 2.25"
_REDUNDANT = f"({equivalent_sql('cand.tokens', 'res.tokens')} and not {gain_sql('res.tokens', 'cand.tokens')})"


@query(f"with {_RESCUE} select distinct res.video_id, res.sample_idx from res join cand on {_NEAR} where {_REDUNDANT}")
def local_coverage(spark, d):
    return promote.locally_covered(*_split(spark, d))


@query(f"with {_RESCUE}, hit as (select distinct res.video_id, res.sample_idx from res join cand on {_NEAR} where {_REDUNDANT}) select video_id, sample_idx from res anti join hit using (video_id, sample_idx)")
def redundant_anti(spark, d):
    return promote.not_redundant(*_split(spark, d)).select("video_id", "sample_idx")


_JUDGED = f"""{_RESCUE}, fs as (select *, row_number() over (partition by video_id order by ts, sample_idx) as o from cand),
pr as (select res.video_id, res.sample_idx, res.ts, res.tokens as rt, res.proxy_content_score as rs, min(abs(cand.ts - res.ts)) filter (where cand.scene_id = res.scene_id) as scene_gap, min(abs(cand.ts - res.ts)) as any_gap,
coalesce(bool_or({_NEAR.replace('res.video_id = cand.video_id and ', '')} and {_REDUNDANT}), false) as covered, arg_min(cand.sample_idx, row(abs(cand.ts - res.ts), cand.ts)) filter (where cand.scene_id = res.scene_id) as near_idx, arg_min(cand.sample_idx, cand.ts) as first_idx from res left join cand on res.video_id = cand.video_id group by all),
pp as (select pr.*, coalesce(near_idx, first_idx) as primary_idx, coalesce(c.tokens, []) as pt, c.proxy_content_score as ps, c.sample_idx is null as alone from pr left join cand c on pr.video_id = c.video_id and c.sample_idx = coalesce(near_idx, first_idx)),
rr as (select *, ({' or '.join(f"len({strict_sql(k, 'rt')}) > 0" for k in ev.KINDS)}) as marked, {gain_sql('rt', 'pt')} as gain, {meaningful_sql('pt', 'rt')} as meaning, {_HAS('pt')} as phas, len(list_filter(rt, lambda x: x in {LIST(ev.SOURCES)} or regexp_matches(x, '[._-]'))) > 0 as refers, len(list_filter(rt, lambda x: not list_contains(pt, x))) as token_gain,
{' + '.join(f"len(list_filter({strict_sql(k, 'rt')}, lambda x: not list_contains({strict_sql(k, 'pt')}, x)))" for k in ev.KINDS)} as marker_gain from pp),
jd as (select *, case when alone then case when refers then 'content_reference' else 'evidence_marker' end when marked and (not phas or gain) and (meaning or gain) and not covered then 'evidence_marker' when rs >= ps * 1.3 and rs - ps >= 0.15 and refers then 'content_reference' when rs >= ps * 1.3 and rs - ps >= 0.15 and token_gain >= 3 and len(rt) >= 4 then 'token_gain' when coalesce(scene_gap, 1e300) > 2.25 and (refers or len(rt) >= 20 or (marked and not covered)) then 'temporal_coverage' end as reason from rr),
el as (select *, not covered and reason is not null as eligible, case reason when 'evidence_marker' then 4 when 'temporal_coverage' then 3 when 'content_reference' then 2 when 'token_gain' then 1 else 0 end as reason_priority, coalesce(scene_gap, any_gap, 0) as temporal_gap from jd)"""


@query(f"with {_JUDGED} select video_id, sample_idx, primary_idx, covered as redundant, reason, eligible, marker_gain::bigint as marker_gain, gain as form_state_delta, token_gain::bigint as token_gain, temporal_gap from el")
def promotion_reason(spark, d):
    return promote.judged(*_split(spark, d)).select("video_id", "sample_idx", "primary_idx", "redundant", "reason", "eligible", F.col("marker_gain").cast("bigint").alias("marker_gain"), "form_state_delta", F.col("token_gain").cast("bigint").alias("token_gain"), "temporal_gap")


_PRIORITY = "gain desc, reason_priority desc, marker_gain desc, token_gain desc, temporal_gap desc, rs desc, ts, sample_idx"


@query(f"with {_JUDGED}, rk as (select *, row_number() over (partition by video_id order by {_PRIORITY}) as rescue_priority from el where eligible) select video_id, sample_idx, reason as rescue_reason, rescue_priority from rk where rescue_priority <= 5")
def additive_promotion(spark, d):
    return promote.additive_promotion(*_split(spark, d), 5).select("video_id", "sample_idx", "rescue_reason", F.col("rescue_priority").cast("bigint").alias("rescue_priority"))


@query(f"with {_JUDGED}, rk as (select *, row_number() over (partition by video_id, eligible order by {_PRIORITY}) as r from el) select video_id, sample_idx, case when eligible then r end as phase_a_rank, case when not eligible then 'predicate_rejected' when r <= 4 then 'eligible_above_headroom' else 'eligible_below_headroom' end as outcome from rk")
def promotion_preflight(spark, d):
    rescue, base = _split(spark, d)
    now = base.withColumn("rescue_origin", F.lit(None).cast("string"))
    return promote.promotion_preflight(base, rescue, now, 4).select("video_id", "sample_idx", F.col("phase_a_rank").cast("bigint").alias("phase_a_rank"), "outcome")


@query()
def swap_promotion(spark, d):
    """Order-dependent; tests hold it against known cases."""
    rows, listed = views.candidates(spark, d), F.col("sample_idx") % 3 == 2
    # candidates show what every form shows, rescue rows all they have
    shown = F.filter("tokens", lambda t: t.isin("form", "request", "owner", "unit", "date", "review", "case"))
    rows = rows.withColumn("listed", listed).withColumn("clip_cluster", (F.col("scene_id") % 3).cast("bigint"))
    rows = rows.withColumn("tokens", F.when(listed, F.col("tokens")).otherwise(shown)).withColumn("proxy_content_score", F.col("proxy_content_score") + F.when(listed, 1).otherwise(0))
    return promote.swap_promotion_within(rows, 2, 8)


# Lanes


@query(f"""with {_PEAK}, lp as (select *, max(sample_idx) over (partition by video_id) as li from peak), c as (select *, greatest(prev_delta, next_delta) / 255 + 0.25 * band_change + 0.10 * proxy_content_score as sc from lp where sample_idx > 0 and sample_idx < li and eligible and threshold is not null and (local_peak or settled or band_change >= 0.2)),
rk as (select c.*, row_number() over (partition by c.video_id order by sc desc, ts, sample_idx) as pos, least(ocr_cap, greatest(2 * rescue_budget, windows + scenes, 8)) as cap from c join lim using (video_id)) select video_id, sample_idx, pos from rk where pos <= cap""")
def content_lane(spark, d):
    return propose.content_lane(_peaks(spark, d)).select("video_id", "sample_idx", F.col("pos").cast("bigint").alias("pos"))


@query(f"""with {_ELIGIBLE}, e as (select *, row_number() over (partition by video_id, scene_id, temporal_window_id order by proxy_content_score desc, ts, sample_idx) as r from norm where eligible),
f as (select *, abs(ts - min_by(ts, r) over (partition by video_id, scene_id, temporal_window_id)) >= 2.25 as far from e), s as (select *, row_number() over (partition by video_id, scene_id, temporal_window_id, far order by proxy_content_score desc, ts, sample_idx) as fr from f),
p as (select *, case when r = 1 then 1 when far and fr = 1 then 2 end as pick from s), n as (select video_id, scene_id, count(distinct temporal_window_id) as nw from e group by all),
t as (select p.*, nw, row_number() over (partition by p.video_id, p.scene_id, pick is null order by proxy_content_score desc, ts, sample_idx) as tr from p join n using (video_id, scene_id)),
u as (select *, case when pick is null and nw > 1 and tr = 1 then 3 else pick end as pk from t) select video_id, sample_idx, case when pk = 3 then 'scene_coverage' else 'temporal_coverage' end as lane, row_number() over (partition by video_id order by pk, scene_id, temporal_window_id) as pos from u where pk is not null""")
def coverage_lane(spark, d):
    rows, _ = _eligible(spark, d)
    return propose.coverage_lane(rows).select("video_id", "sample_idx", "lane", F.col("pos").cast("bigint").alias("pos"))


@query()
def legacy_lane(spark, d):
    """Order-dependent; tests hold it against plain Python."""
    return propose.legacy_lane(_peaks(spark, d))


@query()
def shortlist_union(spark, d):
    """Ordered union of the lanes, one of which is order-dependent."""
    return propose.shortlist(_peaks(spark, d))


# Survival


def fold_sql(rows: str, alike: str, at: str, value: str) -> str:
    """A fold over each recording of ``rows``: a row goes to the place ``at`` (of ``acc``, for ``x``; null for a new one) and takes it if its ``value`` is larger.

    ``alike`` holds of two rows a before b; what a row is like to is found before the fold. A place's last holder is the
    survivor of all that went there.
    """
    held = f"case when {value.format('x')} > {value.format('e')} then struct_pack(i := x.i, t := x.t, n := x.n, s := x.s, l := x.l, m := list_append(e.m, x.i)) else struct_pack(i := e.i, t := e.t, n := e.n, s := e.s, l := e.l, m := list_append(e.m, x.i)) end"
    return f"""{rows}, pairs as (select b.video_id, b.sample_idx, list(a.sample_idx) as l from seen a join seen b on a.video_id = b.video_id and a.sample_idx < b.sample_idx and {alike} group by all),
seq as (select video_id, list(struct_pack(i := sample_idx, t := ts, n := len(tokens), s := candidate_score, l := coalesce(l, []), m := [sample_idx]) order by ts, sample_idx) as xs from seen left join pairs using (video_id, sample_idx) group by video_id),
folded as (select video_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, nw: list_transform([nw[1]], lambda x: list_transform([{at}], lambda k: case when k is null then list_append(acc, x) else list_transform(acc, lambda e, q: case when q = k then {held} else e end) end)[1])[1]) as alive from seq),
places as (select video_id, unnest(alive) as p from folded)
select video_id, unnest(p.m) as sample_idx, unnest(p.m) = p.i as kept, p.i as survivor_idx from places"""


_SEEN = f"with {V4}, seen as (select *, {', '.join(f'{raw_sql(k, "tokens")} as m_{k}' for k in ev.KINDS)} from v4)"
_TOKEN_JACCARD = "len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))::double"
_MAY_MERGE = f"greatest(len(a.tokens), len(b.tokens)) < 2 * least(len(a.tokens), len(b.tokens)) and not ({' or '.join(f'(len(a.m_{k}) > 0 and len(b.m_{k}) > 0 and a.m_{k} <> b.m_{k})' for k in ev.KINDS)}) and {_TOKEN_JACCARD}"
_ALIKE_AT = "list_filter(range(1, len(acc) + 1), lambda q: list_contains(x.l, acc[q].i))"
_BEFORE = "coalesce(list_max(list_filter(range(1, len(acc) + 1), lambda q: abs(x.t - acc[q].t) > 2)), 0)"


@query(fold_sql(_SEEN, f"b.ts - a.ts <= 2 and {_MAY_MERGE} >= 0.9", f"list_max(list_filter({_ALIKE_AT}, lambda q: q > {_BEFORE.replace('q', 'r')}))", "row({0}.s, -{0}.t)"))
def near_time_dedupe(spark, d):
    return survive.near_time_dedupe(views.candidates(spark, d)).select("video_id", "sample_idx", "kept", "survivor_idx")


@query(fold_sql(_SEEN, f"{_MAY_MERGE} >= 0.85", f"list_min({_ALIKE_AT})", "row({0}.s, -{0}.t)"))
def global_dedupe(spark, d):
    return survive.global_dedupe(views.candidates(spark, d)).select("video_id", "sample_idx", "kept", "survivor_idx")


_STATE = "struct_pack(t := ts, k := tokens, s := candidate_score, i := sample_idx)"


@query(f"""with {V4}, seq as (select video_id, list({_STATE} order by ts, sample_idx) as xs from v4 group by all),
fold as (select video_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, nw: case when nw[1].t - acc[-1].t <= 90 and not {differ_sql('acc[-1].k', 'nw[1].k')} and not (greatest(len(acc[-1].k), len(nw[1].k)) >= 2 * least(len(acc[-1].k), len(nw[1].k))) and len(list_intersect(acc[-1].k, nw[1].k)) / len(list_distinct(list_concat(acc[-1].k, nw[1].k)))::double >= 0.82
then case when row(len(nw[1].k), nw[1].s, -nw[1].t) > row(len(acc[-1].k), acc[-1].s, -acc[-1].t) then list_append(acc[1:-2], nw[1]) else acc end else list_append(acc, nw[1]) end) as alive from seq)
select video_id, unnest(list_transform(alive, lambda a: a.i)) as sample_idx from fold""")
def adjacent_dedupe(spark, d):
    return survive.adjacent_dedupe(views.candidates(spark, d)).where("kept").select("video_id", "sample_idx")


# the content is the scene and the number of tokens
_CHANGED = f"({gain_sql('a.tokens', 'b.tokens')} or {gain_sql('b.tokens', 'a.tokens')} or len(list_filter(list_concat(list_filter(a.tokens, lambda x: not list_contains(b.tokens, x)), list_filter(b.tokens, lambda x: not list_contains(a.tokens, x))), lambda t: t in {LIST(ev.FORM_STATE)})) >= 2)"


@query(fold_sql(_SEEN, f"a.scene_id = b.scene_id and abs(len(a.tokens) - len(b.tokens)) / 2 <= 2.5 and {_TOKEN_JACCARD} >= 0.9 and not {_CHANGED}", "case when list_contains(x.l, acc[-1].i) then len(acc) end", "row({0}.n, {0}.s, -{0}.t)"))
def content_veto(spark, d):
    rows = views.candidates(spark, d).withColumn("content", F.array(F.col("scene_id") * 1.0, F.size("tokens") * 1.0))
    return survive.content_dedupe(rows).select("video_id", "sample_idx", "kept", "survivor_idx")


# markers are found once a row; lists of a kind differ where both hold something and aren't equal
_PV = f"""{V4}, mk as (select video_id, sample_idx, ts, tokens, {', '.join(f"{raw_sql(k, 'tokens')} as m_{k}" for k in ev.KINDS)} from v4),
pr as (select a.video_id, a.sample_idx as i, b.sample_idx as j, a.tokens as ta, b.tokens as tb, abs(b.ts - a.ts) as dt, ({' or '.join(f"(len(a.m_{k}) > 0 and len(b.m_{k}) > 0 and a.m_{k} <> b.m_{k})" for k in ev.KINDS)}) as differs from mk a join mk b on a.video_id = b.video_id and a.sample_idx < b.sample_idx),
jc as (select *, {_JAC} as jac from pr)"""


@query(f"""with {_PV} select video_id, i, j, case when differs then 'ocr-evidence' when jac < 0.75 then 'ocr-jaccard' when greatest(len(ta), len(tb)) >= 2 * least(len(ta), len(tb)) then 'ocr-density' when dt > 30 then 'time-transcript' else 'merge' end as reason, round(jac, 6) as jaccard from jc""")
def pair_verdicts(spark, d):
    """All pairs i < j of a recording, however far apart."""
    return merge.pair_verdicts(_candidates_once(spark, d)).select("video_id", "i", "j", "reason", r6("jaccard").alias("jaccard"))


# a component holds at most one marker set of a kind that isn't empty; of the state, g is each sample's component and k_<kind> each component's markers
_JOIN_OK = " and ".join(f"(acc.k_{k}[acc.g[x.a]] = '' or acc.k_{k}[acc.g[x.b]] = '' or acc.k_{k}[acc.g[x.a]] = acc.k_{k}[acc.g[x.b]])" for k in ev.KINDS)
_JOINED = "struct_pack(g := list_transform(acc.g, lambda v: case when v = acc.g[x.b] then acc.g[x.a] else v end), " + ", ".join(f"k_{k} := list_transform(acc.k_{k}, lambda v, q: case when q = acc.g[x.a] and v = '' then acc.k_{k}[acc.g[x.b]] else v end)" for k in ev.KINDS) + ", a := acc.a, b := acc.b)"


@query(f"""{_SEEN}, start as (select video_id, struct_pack(g := list(sample_idx + 1 order by sample_idx), {', '.join(f"k_{k} := list(array_to_string(m_{k}, '|') order by sample_idx)" for k in ev.KINDS)}, a := 0::bigint, b := 0::bigint) as s from seen group by all),
edges as (select a.video_id, list(struct_pack(g := []::bigint[], {', '.join(f"k_{k} := []::varchar[]" for k in ev.KINDS)}, a := a.sample_idx + 1, b := b.sample_idx + 1) order by a.sample_idx, b.sample_idx) as es from seen a join seen b on a.video_id = b.video_id and a.sample_idx < b.sample_idx and b.ts - a.ts <= 30 and {_MAY_MERGE} >= 0.75 group by all),
folded as (select video_id, list_reduce(list_prepend(s, coalesce(es, [])), lambda acc, x: case when acc.g[x.a] <> acc.g[x.b] and {_JOIN_OK} then {_JOINED} else acc end) as f from start left join edges using (video_id)),
member as (select video_id, unnest(f.g) as g, generate_subscripts(f.g, 1) - 1 as sample_idx from folded), first as (select *, min(sample_idx) over (partition by video_id, g) as least from member)
select video_id, sample_idx, (dense_rank() over (partition by video_id order by least) - 1)::int as component from first""")
def union_find_merge(spark, d):
    rows = _candidates_once(spark, d)
    verdicts = merge.pair_verdicts(rows, seconds=30.0)
    return merge.merge_components(rows, verdicts)


@query(f"""with {V4} select video_id, scene_id as component, arg_max(sample_idx, row(candidate_score, -ts)) as sample_idx, array_to_string(list_sort(list(sample_idx)), ' ') as merged_from_sample_idxs, count(*) as members, array_to_string(list_sort(list_distinct(list(cluster_role))), ' ') as lineage_roles from v4 group by all""")
def lineage_rollup(spark, d):
    rows = views.candidates(spark, d).withColumn("component", F.col("scene_id").cast("bigint"))
    out = merge.lineage_rollup(rows, ("component",))
    return out.select("video_id", "component", "sample_idx", F.array_join("merged_from_sample_idxs", " ").alias("merged_from_sample_idxs"), "members", F.array_join("lineage_roles", " ").alias("lineage_roles"))


@query(f"with {V4}, rk as (select *, row_number() over (partition by video_id order by len(tokens) desc, candidate_score desc, ts, sample_idx) as r, count(*) over (partition by video_id) as n from v4) select video_id, sample_idx, r as cap_rank, r > 12 as capped_out, greatest(0, n - 12) as cap_pressure from rk")
def output_cap(spark, d):
    return survive.output_cap(views.candidates(spark, d), 12).select("video_id", "sample_idx", F.col("cap_rank").cast("bigint").alias("cap_rank"), "capped_out", "cap_pressure")


# Transcripts

_CLOCK = lambda x, dec=".": f"printf('%02d:%02d:%02d{dec}%03d', floor(floor({x}) / 3600)::int, floor(floor({x}) % 3600 / 60)::int, (floor({x}) % 60)::int, round(({x} - floor({x})) * 1000)::int)"
_TRIM = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"with {V5} select video_id, seg_no, '[' || {_CLOCK('start_s')} || ' --> ' || {_CLOCK('end_s')} || ']  ' || {_TRIM} as line from v5")
def txt_lines(spark, d):
    return transcript.txt_lines(views.segments(spark, d))


@query(f"with {V5} select video_id, seg_no, row_number() over (partition by video_id order by seg_no) || chr(10) || {_CLOCK('start_s', ',')} || ' --> ' || {_CLOCK('end_s', ',')} || chr(10) || {_TRIM} || chr(10) || chr(10) as block from v5")
def srt_lines(spark, d):
    return transcript.srt_blocks(views.segments(spark, d))


@query(f"with {V5} select video_id, seg_no, {_CLOCK('start_s')} || ' --> ' || {_CLOCK('end_s')} || chr(10) || {_TRIM} || chr(10) || chr(10) as block from v5 union all select distinct video_id, -1, 'WEBVTT' || chr(10) || chr(10) from v5")
def vtt_lines(spark, d):
    return transcript.vtt_blocks(views.segments(spark, d))


@query(f"with {V5}, s as (select video_id, seg_no as sample_idx, start_s as ts from v5), m as (select s.video_id, sample_idx, string_agg({_TRIM}, ' ' order by seg_no) as t from s join v5 on s.video_id = v5.video_id and end_s >= ts - 5 and start_s <= ts + 5 where {_TRIM} <> '' group by all) select s.video_id, s.sample_idx, coalesce(t, '') as transcript_window from s left join m using (video_id, sample_idx)")
def transcript_window(spark, d):
    rows = views.segments(spark, d)
    at = rows.select("video_id", F.col("seg_no").alias("sample_idx"), F.col("start_s").alias("ts"))
    return transcript.transcript_window(at, rows).select("video_id", "sample_idx", "transcript_window")


# Quality assurance: three stages of one recording's samples against wanted times

_STAGED = f"""{V1}, {V6}, st as (select video_id, 'sampling' as stage, sample_idx, ts, [ts] as merged_timestamps from v1 union all select video_id, 'proposal.pass1_primary', sample_idx, ts, [ts] from v1 where sample_idx % 4 = 0 union all select video_id, 'survival.final_post_cap', sample_idx, ts, [ts, ts + 6.0::double] from v1 where sample_idx % 8 = 0),
tg as (select v.video_id, v6.* from v6 cross join (select distinct video_id from v1) v), tm as (select video_id, stage, sample_idx, ts as seen, 'timestamp' as via from st union all select video_id, stage, sample_idx, unnest(merged_timestamps), 'merged_timestamps' from st),
jn as (select tg.video_id, label, tolerance, stage, sample_idx, seen, via, abs(seen - time_s) as delta from tg join tm using (video_id)), nr as (select video_id, label, stage, min(row(case when delta <= tolerance and via = 'timestamp' then 0 when delta <= tolerance then 1 else 2 end, delta, seen, sample_idx)) as b from jn group by all)"""


def _staged(spark, d):
    rows = views.samples(spark, d)
    stage = lambda name, cond, extra: rows.where(cond).select("video_id", F.lit(name).alias("stage"), "sample_idx", "ts", extra.alias("merged_timestamps"))
    st = stage("sampling", F.lit(True), F.array("ts")).unionByName(stage("proposal.pass1_primary", F.col("sample_idx") % 4 == 0, F.array("ts"))).unionByName(stage("survival.final_post_cap", F.col("sample_idx") % 8 == 0, F.array(F.col("ts"), F.col("ts") + 6.0)))
    # every recording is asked about, each for all wanted times
    videos = rows.select("video_id").distinct()
    targets = videos.withColumn("_t", F.lit(1)).join(F.broadcast(views.targets(spark, d).withColumn("_t", F.lit(1))), "_t").drop("_t")
    return targets, st


@query(f"with {_STAGED} select video_id, label, stage, b[1] < 2 as hit, round(b[2], 6) as delta, case b[1] when 0 then 'timestamp' when 1 then 'merged_timestamps' else 'none' end as matched_via, b[4] as sample_idx from nr")
def qa_recall(spark, d):
    found = qa.nearest_in_stage(*_staged(spark, d))
    return found.select("video_id", "label", "stage", "hit", r6("delta").alias("delta"), "matched_via", "sample_idx")


@query(f"""with {_STAGED}, h as (select video_id, label, max(case when stage = 'survival.final_post_cap' then b[1] end) as f, max(case when stage = 'proposal.pass1_primary' then b[1] end) as p, max(case when stage = 'sampling' then b[1] end) as s from nr group by all)
select video_id, label, case when f = 0 then 'hit_direct' when f = 1 then 'hit_lineage_only' when p < 2 then 'coarse_proposal_exists_but_not_selected' when s < 2 then 'sampled_but_no_proposal_near_target' else 'no_sample_near_target' end as bucket, case when f < 2 then 'final' when p < 2 then 'pass1' when s < 2 then 'sampling_only' else 'none' end as best_family from h""")
def qa_bucket(spark, d):
    targets, rows = _staged(spark, d)
    return qa.outcomes(targets, qa.nearest_in_stage(targets, rows)).select("video_id", "label", "bucket", "best_family")


@query(f"with {_STAGED} select stage, count_if(b[1] = 0) as direct, count_if(b[1] = 1) as lineage_only, count_if(b[1] = 2) as miss from nr group by all")
def qa_totals(spark, d):
    targets, rows = _staged(spark, d)
    return qa.totals(qa.nearest_in_stage(targets, rows), targets)


_SNAP = f"""{V4}, st as (select video_id, cluster_role as stage, case when sample_idx % 50 = 49 then null else sample_idx // 2 end as sample_idx, case when sample_idx % 40 = 39 then null else ts end as ts, case when sample_idx % 3 = 0 then [sample_idx // 2] when sample_idx % 3 = 1 then [sample_idx] else []::bigint[] end as mi, case when sample_idx % 4 = 0 then []::double[] else [ts] end as mt, case when sample_idx % 5 = 0 then 'additive_rescue' end as ro, case when sample_idx % 10 = 0 then 'token_gain' end as rr, case when sample_idx % 15 = 0 then 1.5::double else proxy_content_score end as ps from v4)"""


def _snap(spark, d):
    i = F.col("sample_idx")
    rows = views.candidates(spark, d)
    half = F.floor(i / 2)
    none_i, none_t = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    return rows.select(
        "video_id", F.col("cluster_role").alias("stage"), F.when(i % 50 == 49, F.lit(None)).otherwise(half).alias("sample_idx"), F.when(i % 40 == 39, F.lit(None)).otherwise(F.col("ts")).alias("ts"),
        F.when(i % 3 == 0, F.array(half)).when(i % 3 == 1, F.array(i.cast("bigint"))).otherwise(none_i).alias("merged_from_sample_idxs"), F.when(i % 4 == 0, none_t).otherwise(F.array("ts")).alias("merged_timestamps"),
        F.when(i % 5 == 0, "additive_rescue").alias("rescue_origin"), F.when(i % 10 == 0, "token_gain").alias("rescue_reason"), F.when(i % 15 == 0, 1.5).otherwise(F.col("proxy_content_score")).alias("proxy_content_score"),
    )


@query(f"""with {_SNAP}, di as (select video_id, stage, count(*) as n from (select video_id, stage, sample_idx from st where sample_idx is not null group by all having count(*) > 1) group by all), dt as (select video_id, stage, count(*) as n from (select video_id, stage, ts from st where ts is not null group by all having count(*) > 1) group by all)
select st.video_id, st.stage, count(*) as candidates, coalesce(any_value(di.n), 0) as duplicate_sample_idx, coalesce(any_value(dt.n), 0) as duplicate_ts from st left join di using (video_id, stage) left join dt using (video_id, stage) group by all""")
def stage_snapshot(spark, d):
    return qa.stage_snapshot(_snap(spark, d))


@query(f"""with {_SNAP} select video_id, stage, reason, count(*) as n from (select video_id, stage, unnest(list_filter([case when ts is null then 'missing_timestamp' end, case when sample_idx is null then 'missing_sample_idx' end, case when len(mi) > 0 and len(mt) = 0 then 'merged_idxs_without_timestamps' end, case when len(mi) > 0 and sample_idx is not null and not list_contains(mi, sample_idx) then 'sample_idx_missing_from_merged_idxs' end, case when len(mt) > 0 and ts is not null and not (abs(mt[1] - ts) < 1e-6) then 'timestamp_missing_from_merged_timestamps' end, case when ro is not null and rr is null then 'rescue_origin_without_reason' end, case when ro is not null and (ps is null or ps < 0 or ps > 1) then 'invalid_rescue_proxy_score' end], lambda x: x is not null)) as reason from st) group by all""")
def integrity_violations(spark, d):
    return qa.integrity_violations(_snap(spark, d)).groupBy("video_id", "stage", "reason").agg(F.count("*").alias("n"))
