"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, licenses, mixing, packing, quality, sharding, simhash, spelling, suffix, topk, toxicity, vector_codes

QUERIES = {
    "op1_suffix_array_dedup": suffix.op1_suffix_array_dedup,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_feistel_sharding": sharding.op11_feistel_sharding,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_top_k": topk.OP6_SQL, "op10_license_scan": licenses.sql(), "op11_feistel_sharding": sharding.sql(), "op12_vector_codes": vector_codes.sql(), "op13_spelling_variants": spelling.sql()}
