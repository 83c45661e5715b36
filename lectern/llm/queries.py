"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, language_id, near_dedup, packing, quality_classifier, quality_rules, secrets, substring_dedup, url_filters

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_quality": quality_classifier.op5_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_language_id": language_id.op7_language_id,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontamination.op10_decontaminate,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_secrets": secrets.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_url_filters": url_filters.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op8_chat_format": chat_format.SQL,
}
