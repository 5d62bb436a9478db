"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover_tree, divergence, html_text, jaccard_join, language_id, mixing, order_minhash, quality, simhash, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_toxicity": toxicity.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_html_text": html_text.query,
    "op5_bpe_encoding": bpe.query,
    "op6_language_id": language_id.query,
    "op7_quality_classifier": quality.query,
    "op8_mixing_sources": mixing.query,
    "op9_order_minhash": order_minhash.query,
    "op10_exact_top_k": cover_tree.query,
    "op11_simhash": simhash.query,
    "op12_vector_codes": vector_codes.query,
    "op13_source_divergence": divergence.query,
}

ORACLES: dict[str, str] = {
    "op1_token_counts": token_counts.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op8_mixing_sources": mixing.SQL,
    "op10_exact_top_k": cover_tree.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_source_divergence": divergence.SQL,
}
