"""What recognised text says about a sample: document frequencies, token sets with counts, and the source of a caption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence, tokens
from .segment import KEY


def document_frequency(texts: DataFrame, text: str = "ocr_text", key: str = KEY) -> DataFrame:
    """(key, token, docs): in how many samples of the recording a token stands."""
    return texts.select(key, F.explode(tokens.token_set(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("docs"))


def filter_frequent(texts: DataFrame, text: str = "ocr_text", key: str = KEY, share: float = 0.5, most: int = 70) -> DataFrame:
    """``filtered_text``: the words of at most ``share`` of the recording's samples, the first ``most``, joined by spaces.

    Words without letters or digits always stay; in a recording of one sample no other word does.
    """
    counts = texts.groupBy(key).agg(F.count("*").alias("_n"))
    word = texts.select(key, "sample_idx", F.posexplode(tokens.words(F.col(text))).alias("_pos", "_word")).withColumn("token", tokens.normalized(F.col("_word")))
    kept = word.join(document_frequency(texts, text, key), [key, "token"], "left").join(counts, key).where(F.coalesce("docs", F.lit(0)) / F.col("_n") <= share)
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy(key, "sample_idx").orderBy("_pos"))).where(F.col("_r") <= most)
    joined = first.groupBy(key, "sample_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_word"))), lambda x: x["_word"]), " ").alias("filtered_text"))
    return texts.join(joined, [key, "sample_idx"], "left").withColumn("filtered_text", F.coalesce("filtered_text", F.lit("")))


def attribute(texts: DataFrame, text: str = "ocr_text", key: str = KEY) -> DataFrame:
    """Token sets, signatures and counts of each sample: ocr_tokens, rescue_tokens, ocr_line_signature, field_signature,
    raw_token_count, filtered_token_count, cleaned_token_count, cleaning_attrition_ratio, caption_source."""
    rows = filter_frequent(texts, text, key)
    raw, filtered = tokens.token_set(F.col(text)), tokens.token_set(F.col("filtered_text"))
    rows = rows.withColumn("ocr_tokens", tokens.as_set(tokens.clean_tokens(filtered))).withColumn("rescue_tokens", tokens.rescue_token_set(F.col(text)))
    rows = rows.withColumn("ocr_line_signature", tokens.line_signatures(F.col(text))).withColumn("field_signature", evidence.field_signatures(F.col(text), F.array_union("rescue_tokens", "ocr_tokens")))
    rows = rows.withColumn("raw_token_count", F.size(raw)).withColumn("filtered_token_count", F.size(filtered)).withColumn("cleaned_token_count", F.size("ocr_tokens"))
    lost = (F.col("raw_token_count") - F.col("cleaned_token_count")) / F.greatest(F.col("raw_token_count"), F.lit(1))
    return rows.withColumn("cleaning_attrition_ratio", F.bround(lost, 4)).withColumn("caption_source", F.when(F.char_length("filtered_text") >= 30, "both").otherwise("florence"))


def cached_text(rows: DataFrame, fresh: DataFrame, key: str = KEY) -> DataFrame:
    """Recognised text that a sample already has stays; the rest takes that of ``fresh`` (key, sample_idx, text)."""
    joined = rows.join(fresh.select(key, "sample_idx", F.col("text").alias("_text")), [key, "sample_idx"], "left")
    source = F.col("ocr_cache_source") if "ocr_cache_source" in rows.columns else F.lit(None).cast("string")
    had = F.col("ocr_text").isNotNull()
    return joined.withColumn("ocr_cache_source", F.when(had, F.coalesce(source, F.lit("rescue"))).otherwise(source)).withColumn("ocr_text", F.coalesce("ocr_text", "_text")).drop("_text")
