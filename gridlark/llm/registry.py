"""Queries of this folder for ``__spark_entry__``, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from gridlark.llm import decontaminate, html_text, language_id, line_quality, mixing, near_dup, sharding, token_counts, tool_calls, url_filter

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_line_quality": line_quality.op3_line_quality,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_html_text": html_text.op5_html_text,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": language_id.op7_language_id,
    "op8_sharding": sharding.op8_sharding,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_near_dup": near_dup.op10_near_dup,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {**line_quality.ORACLE, **mixing.ORACLE, **near_dup.ORACLE, **tool_calls.ORACLE, **url_filter.ORACLE}
