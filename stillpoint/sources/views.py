"""Views that give plain tables the shapes of samples, features, texts, candidates, segments and targets.

Each view exists twice: as a DataFrame for Spark, and as a query for DuckDB that the SQL twins inline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one recording for each user; ts is hours since 2024 as seconds, v any metric of a sample."""
    return spark.sql(
        """select user_id as video_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_idx, event_id as frame_idx,
        (unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) / 3.6e9D as ts, value as v, event_type as kind from {events}""",
        events=table(spark, sf_dir, "events"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one recording for each label, a 63-bit hash of each vector."""
    from ..functions.hashing import vector_hash

    rows = spark.sql(
        """select label as video_id, row_number() over (partition by label order by vec_id) - 1 as sample_idx, vec_id as frame_idx,
        (row_number() over (partition by label order by vec_id) - 1) * 0.5D as ts, embedding from {embeddings}""",
        embeddings=table(spark, sf_dir, "embeddings"),
    )
    return rows.withColumn("dhash", vector_hash(rows["embedding"]))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one recording for each source; recognised text of several lines."""
    return spark.sql("select source as video_id, row_number() over (partition by source order by doc_id) - 1 as sample_idx, doc_id as frame_idx, lang, text as ocr_text from {documents}", documents=table(spark, sf_dir, "documents"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: one recording for each customer, one scene for each order; tokens with pages, status, dates and form states.

    Tokens are made after the rows of a recording have met: short columns are shuffled, not lists. They meet by video_id,
    so that what goes on by recording needs no further shuffle.
    """
    return spark.sql(
        """select video_id, sample_idx, frame_idx, ts, scene_id, cluster_role, candidate_score, proxy_content_score, array_sort(array_distinct(array_compact(array('form', 'request', 'owner', 'unit', 'date', 'review', 'case', lower(p_type),
        case o_orderstatus when 'F' then 'approved' when 'O' then 'draft' else 'pending' end,
        case when l_linenumber in (1, 3) then concat('page', l_linenumber) end, word,
        case when l_returnflag = 'R' then lower(date_format(l_shipdate, 'ddMMMyyyy')) end, case when l_linestatus = 'F' and l_linenumber > 3 then 'please' end, case when l_linestatus = 'F' and l_linenumber > 3 then 'selection' end)))) as tokens
        from (select video_id, row_number() over w - 1 as sample_idx, l_orderkey * 10 + l_linenumber as frame_idx, (row_number() over w - 1) * 0.5D as ts,
        dense_rank() over (partition by video_id order by o_orderdate, l_orderkey) - 1 as scene_id, case when l_linenumber = 1 then 'primary' else 'alt' end as cluster_role,
        l_quantity as candidate_score, l_discount * 10 as proxy_content_score, p_type, o_orderstatus, l_linenumber, case when l_linenumber = 2 then split(p_name, ' ')[0] end as word, l_returnflag, l_linestatus, l_shipdate
        from (select *, o_custkey as video_id from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey)
        window w as (partition by video_id order by o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))""",
        lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders").hint("merge"), part=table(spark, sf_dir, "part").hint("merge"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: transcript segments, four seconds a turn."""
    return spark.sql("select conv_id as video_id, turn as seg_no, turn * 4.0D as start_s, turn * 4.0D + 3.5D as end_s, text from {conversations}", conversations=table(spark, sf_dir, "conversations"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: wanted times."""
    return spark.sql("select item_id as label, item_id * 1.75D as time_s, 2.25D as tolerance from {benchmark}", benchmark=table(spark, sf_dir, "benchmark"))


V1 = """v1 as (select user_id as video_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_idx, event_id as frame_idx,
  (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 3.6e9::double as ts, value as v, event_type as kind from events)"""
V2 = """v2 as (select label as video_id, row_number() over (partition by label order by vec_id) - 1 as sample_idx, vec_id as frame_idx, (row_number() over (partition by label order by vec_id) - 1) * 0.5::double as ts,
  embedding, list_reduce(list_transform(range(1, 64), lambda i: (embedding[i] > embedding[i + 1])::bigint), lambda a, b: a * 2 + b) as dhash from embeddings)"""
V3 = "v3 as (select source as video_id, row_number() over (partition by source order by doc_id) - 1 as sample_idx, doc_id as frame_idx, lang, text as ocr_text from documents)"
V4 = """v4 as (select o_custkey as video_id, row_number() over w - 1 as sample_idx, l_orderkey * 10 + l_linenumber as frame_idx, (row_number() over w - 1) * 0.5::double as ts,
  dense_rank() over (partition by o_custkey order by o_orderdate, l_orderkey) - 1 as scene_id, case when l_linenumber = 1 then 'primary' else 'alt' end as cluster_role,
  l_quantity as candidate_score, l_discount * 10 as proxy_content_score, list_sort(list_distinct(['form', 'request', 'owner', 'unit', 'date', 'review', 'case', lower(p_type),
  case o_orderstatus when 'F' then 'approved' when 'O' then 'draft' else 'pending' end,
  case when l_linenumber in (1, 3) then concat('page', l_linenumber) end, case when l_linenumber = 2 then split(p_name, ' ')[1] end,
  case when l_returnflag = 'R' then lower(strftime(l_shipdate, '%d%b%Y')) end, case when l_linestatus = 'F' and l_linenumber > 3 then 'please' end, case when l_linestatus = 'F' and l_linenumber > 3 then 'selection' end])) as tokens
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  window w as (partition by o_custkey order by o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))"""
V5 = "v5 as (select conv_id as video_id, turn as seg_no, turn * 4.0::double as start_s, turn * 4.0::double + 3.5::double as end_s, text from conversations)"
V6 = "v6 as (select item_id as label, item_id * 1.75::double as time_s, 2.25::double as tolerance from benchmark)"
