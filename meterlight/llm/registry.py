"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, exact_dedup, html_extract, language_id, lexical_search, line_dedup, lm_score, metric_search, periodic_runs, simhash, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_simhash": simhash.op3_simhash,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": language_id.op5_language_id,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_metric_search": metric_search.op12_metric_search,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op11_lexical_search": lexical_search.ORACLE_SQL,
        "op12_metric_search": metric_search.ORACLE_SQL,
    }
