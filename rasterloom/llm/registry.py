"""Queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import chat_format, decontaminate, html_extract, line_dedup, media, ngram_join, packing, quality, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_media": media.op2_media,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_token_file": token_file.op7_token_file,
        "op8_quality": quality.op8_quality,
        "op9_packing": packing.op9_packing,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.OP10_SQL}
