"""Queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from grovemap.llm import op1_risk_rules, op2_revisits, op3_licences, op4_mixing, op5_sharding, op6_nbsvm, op7_decontaminate, op8_simhash, op9_pii, op10_urls

QUERIES = {
    "op1_quality_rules": op1_risk_rules.op1_quality_rules,
    "op2_warc_revisits": op2_revisits.op2_warc_revisits,
    "op3_licence_scan": op3_licences.op3_licence_scan,
    "op4_mixing": op4_mixing.op4_mixing,
    "op5_sharding": op5_sharding.op5_sharding,
    "op6_quality_classifier": op6_nbsvm.op6_quality_classifier,
    "op7_benchmark_decontamination": op7_decontaminate.op7_benchmark_decontamination,
    "op8_simhash_near_dedup": op8_simhash.op8_simhash_near_dedup,
    "op9_personal_data": op9_pii.op9_personal_data,
    "op10_url_filter": op10_urls.op10_url_filter,
}
ORACLE_SQL = {"op1_quality_rules": op1_risk_rules.SQL, "op2_warc_revisits": op2_revisits.SQL, "op3_licence_scan": op3_licences.SQL, "op4_mixing": op4_mixing.SQL, "op5_sharding": op5_sharding.SQL}
#: The same operators where small tables can't show what they do.
SHOWN = {"quality_rules_at_half": op1_risk_rules.rules_at_half, "licence_texts": op3_licences.licence_texts}
SHOWN_SQL = {"quality_rules_at_half": op1_risk_rules.HALF_SQL, "licence_texts": op3_licences.TEXTS_SQL}
