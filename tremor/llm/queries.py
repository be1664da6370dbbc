"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, language_id, line_dedup, packing, quality_rules, secret_scan, simhash, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_simhash": simhash.op6_simhash,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLES = {
    "op5_secret_scan": secret_scan.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
