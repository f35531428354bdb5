"""The queries of this package and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.chat import op9_chat_formatting
from tallyspark.llm.decontaminate import op1_benchmark_decontamination
from tallyspark.llm.fill_middle import op12_fill_in_middle
from tallyspark.llm.hard_negatives import op13_hard_negatives
from tallyspark.llm.jaccard_join import op2_ngram_jaccard_join
from tallyspark.llm.language import op11_language_id
from tallyspark.llm.licenses import op3_license_scans
from tallyspark.llm.neighbours import op5_nearest_neighbours
from tallyspark.llm.oracle import ORACLE_SQL
from tallyspark.llm.pieces import op10_sentencepiece
from tallyspark.llm.pii import op8_pii
from tallyspark.llm.secrets import op7_secret_scans
from tallyspark.llm.substring_dedup import op6_substring_dedup
from tallyspark.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scans": op3_license_scans,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_pii": op8_pii,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_language_id": op11_language_id,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
