"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, exact_dedup, filter_audit, html_extract, language_id, mixing, pii, secrets, simhash, suffix_dedup, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.query,
        "op2_secrets": secrets.query,
        "op3_language_id": language_id.query,
        "op4_html": html_extract.query,
        "op5_mixing": mixing.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_chat": chat.query,
        "op7_chat_whole": chat.query_whole,
        "op8_pii": pii.query,
        "op9_simhash": simhash.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_toxicity": toxicity.query,
        "op12_filter_audit": filter_audit.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": chat.SQL, "op7_chat_whole": chat.SQL_WHOLE, "op10_exact_dedup": exact_dedup.SQL, "op12_filter_audit": filter_audit.SQL, "op13_vector_codes": vector_codes.SQL}
