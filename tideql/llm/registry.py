"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, language, licenses, minhash, quality_mil, quality_rules, sentencepiece_table, suffix_array, token_counts, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "quality_base_counts": quality_rules.base_counts,
    "op2_quality_mil": quality_mil.op2,
    "op3_suffix_array": suffix_array.op3,
    "op4_language": language.op4,
    "op5_token_counts": token_counts.op5,
    "op6_toxicity": toxicity.op6,
    "op7_license_scan": licenses.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_minhash": minhash.op9,
    "op10_sentencepiece": sentencepiece_table.op10,
}

ORACLE_SQL: dict[str, str] = {
    "quality_base_counts": quality_rules.SQL_BASE,
    "op3_suffix_array": suffix_array.SQL3,
    "op7_license_scan": licenses.SQL7,
    "op8_decontaminate": decontaminate.SQL8,
    "op9_minhash": minhash.SQL9,
}
