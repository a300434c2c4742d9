"""The queries of this subpackage and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embeddings, html_text, language, mixing, pii, quality, simhash, suffix_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_files": token_files.op3_token_files,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op5_html_text": html_text.op5_html_text,
    "op6_language": language.op6_language,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_embedding_neardup": embeddings.op10_embedding_neardup,
}

SQL: dict[str, str] = {"op4_benchmark_decontamination": decontamination.SQL}
