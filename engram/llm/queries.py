"""Queries of the corpus operators over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from engram.llm import collocations, compression_quality, context_mixing, decontamination, license_scan, mixture, near_duplicates, packing, quality_rules, substring_dedup, token_output, toxicity, whitening

QUERIES = {
    "op1_compression_quality": compression_quality.query,
    "op2_context_mixing": context_mixing.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_near_duplicates": near_duplicates.query,
    "op5_quality_rules": quality_rules.query,
    "op6_source_mixing": mixture.query,
    "op7_license_scan": license_scan.query,
    "op8_decontamination": decontamination.query,
    "op9_toxicity": toxicity.query,
    "op10_token_output": token_output.query,
    "op11_whitening": whitening.query,
    "op12_collocations": collocations.query,
    "op13_packing": packing.query,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_near_duplicates": near_duplicates.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
