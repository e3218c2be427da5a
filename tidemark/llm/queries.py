"""The queries of this subpackage and their SQL, added to the engine's by ``__spark_entry__``."""

from __future__ import annotations

from . import ann, bpe, centroid_clustering, fingerprints, language_id, lm_scoring, near_dedup, packing, prefix_trie, quality_rules, suffix_dedup, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_packing": packing.op2_packing,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_ann": ann.op5_ann,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_language_id": language_id.op9_language_id,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
        "op12_fingerprints": fingerprints.op12_fingerprints,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filters.oracle_sql(),
        "op10_quality_rules": quality_rules.oracle_sql(),
        "op11_centroid_clustering": centroid_clustering.oracle_sql(),
        "op12_fingerprints": fingerprints.oracle_sql(),
        "op13_prefix_trie": prefix_trie.oracle_sql(),
    }
