"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, embedding_dedup, html_text, mixing, ngram_join, quality, suffix_dedup, token_count, toxicity, url_filter


def queries() -> dict[str, Callable]:
    found = [
        token_count.op1_token_count,
        quality.op2_quality,
        suffix_dedup.op3_suffix_dedup,
        mixing.op4_mixing,
        html_text.op5_html_text,
        url_filter.op6_url_filter,
        toxicity.op7_toxicity,
        ngram_join.op8_ngram_join,
        embedding_dedup.op9_embedding_dedup,
        decontaminate.op10_decontamination,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": suffix_dedup.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op8_ngram_join": ngram_join.ORACLE,
        "op9_embedding_dedup": embedding_dedup.ORACLE,
        "op10_decontamination": decontaminate.ORACLE,
    }
