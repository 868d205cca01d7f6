"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, html, language, licenses, minhash, mixing, quality, simhash, substrings, topk, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (licenses.op1_license_scan, simhash.op2_simhash, topk.op3_exact_topk, bpe.op4_byte_bpe, substrings.op5_substring_dedup, quality.op6_quality_rules, html.op7_html_extraction, mixing.op8_source_mixing, language.op9_language_id, bpe.op10_token_counts, whitening.op11_whitening, minhash.op12_minhash, codes.op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": topk.SQL, "op5_substring_dedup": substrings.SQL, "op6_quality_rules": quality.SQL, "op12_minhash": minhash.SQL, "op13_vector_codes": codes.SQL}
