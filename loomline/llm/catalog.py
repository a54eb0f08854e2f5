"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomline.llm import (
    chunk_dedup,
    decontamination,
    exact_dedup,
    html_text,
    language,
    packing,
    preference,
    simhash,
    suffix_dedup,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": html_text.op1_html,
        "op2_preference": preference.op2_preference,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_language": language.op8_language,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_chunk_dedup": chunk_dedup.op10_chunk_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_preference": preference.ORACLE, "op4_url_filter": url_filter.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
