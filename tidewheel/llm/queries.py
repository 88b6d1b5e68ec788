"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewheel.llm import decontamination, licenses, mixing, near_dups, quality_classifier, quality_rules, secrets, token_counts, url_filters, warc

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_near_dups": near_dups.op2_near_dups,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_secrets": secrets.op6_secrets,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_licenses": licenses.op9_licenses,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLES = {
    "op2_near_dups": near_dups.ORACLE_OP2,
    "op5_decontamination": decontamination.ORACLE_OP5,
    "op7_warc": warc.ORACLE_OP7,
}
