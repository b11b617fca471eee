"""The corpus operators' entries for the driver: queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from quillon.llm import (
    decontamination, html_tree, language_id, mixing, near_duplicates, quality_rules, secret_scan, sharding, spelling_variants, suffix_lm, token_files, toxicity, whitening,
)

QUERIES = {
    "op1_dom_tree_extraction": html_tree.op1_dom_tree_extraction,
    "op2_kneser_ney_toxicity": toxicity.op2_kneser_ney_toxicity,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_decision_list": quality_rules.op4_decision_list,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_blob_ledger": secret_scan.op6_blob_ledger,
    "op7_minhash_near_dedup": near_duplicates.op7_minhash_near_dedup,
    "op9_zstd_token_files": token_files.op9_zstd_token_files,
    "op10_suffix_tree_scores": suffix_lm.op10_suffix_tree_scores,
    "op8_feistel_sharding": sharding.op8_feistel_sharding,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_rank_order_profiles": language_id.op12_rank_order_profiles,
    "op13_block_lanczos_whitening": whitening.op13_block_lanczos_whitening,
}

ORACLES = {
    "op3_source_mix": mixing.op3_sql(),
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_blob_ledger": secret_scan.op6_sql(),
    "op8_feistel_sharding": sharding.op8_sql(),
    "op11_spelling_variants": spelling_variants.op11_sql(),
    "op12_rank_order_profiles": language_id.op12_sql(),
}
