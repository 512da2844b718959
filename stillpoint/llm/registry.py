"""Queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprints, html_extract, jaccard_join, packing, pii, quality, secret_scan, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scans": secret_scan.op1_secret_scans,
        "op2_bpe_encode_decode": bpe.op2_bpe_encode_decode,
        "op3_approximate_nearest_neighbours": ann.op3_approximate_nearest_neighbours,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
        "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_pii_surrogates": pii.op8_pii_surrogates,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard_join": jaccard_join.OP5_SQL}
