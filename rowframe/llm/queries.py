"""The registered training-data queries and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rowframe.llm.ann import op1_nearest_neighbours
from rowframe.llm.chat import OP5_SQL, op5_chat_format
from rowframe.llm.decontam import OP3_SQL, op3_decontamination
from rowframe.llm.hmm import op10_hmm_scoring
from rowframe.llm.html_crf import op7_html_extraction
from rowframe.llm.jaccard import op8_jaccard_join
from rowframe.llm.langid import op6_language_id
from rowframe.llm.packing import op9_best_fit_packing
from rowframe.llm.pii import op4_pii
from rowframe.llm.substring import OP2_SQL, op2_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_html_extraction": op7_html_extraction,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_hmm_scoring": op10_hmm_scoring,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_chat_format": OP5_SQL,
}
