"""Queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import byte_bpe, chat_format, html_text, jaccard_join, language_id, quality_rules, recurrent_lm, source_mix, url_filter, vector_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_language_id": language_id.op2_language_id,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_recurrent_lm": recurrent_lm.op5_recurrent_lm,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_exact_topk": vector_topk.op9_exact_topk,
    "op10_html_extraction": html_text.op10_html_extraction,
}

SQL: dict[str, str] = {
    "op1_url_filters": url_filter.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_source_mix": source_mix.SQL,
    "op6_chat_format": chat_format.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_exact_topk": vector_topk.SQL,
}
