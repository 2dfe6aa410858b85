"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, exact_dedup, license_scans, lm_scoring, minhash_dedup, mixing, packing, pii, quality_rules, secret_scans, simhash_dedup, source_audit, url_filters

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_license_scans": license_scans.op10_license_scans,
    "op11_alignment": alignment.op11_alignment,
    "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
    "op13_source_audit": source_audit.op13_source_audit,
}
SQL = {"op3_exact_dedup": exact_dedup.ORACLE, "op13_source_audit": source_audit.ORACLE}
