"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from termforge.llm import chat_format, decontaminate, html_extract, language_id, lm_scoring, near_dedup, packing, pii, token_output, winnowing

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_language_id": language_id.op8_language_id,
    "op9_token_output": token_output.op9_token_output,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat_format.OP1_SQL,
}
