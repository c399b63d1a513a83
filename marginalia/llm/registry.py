"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import bpe, hilbert_shards, jaccard_join, maxent_lm, mixing, prefix_trie, pu_quality, quality_rules, simhash, token_counts, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_pu_quality": pu_quality.op2_pu_quality,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_hilbert_shards": hilbert_shards.op4_hilbert_shards,
        "op5_warc": warc.op5_warc,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_bpe": bpe.op9_bpe,
        "op10_maxent_lm": maxent_lm.op10_maxent_lm,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_whitening": whitening.op12_whitening,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.ORACLE, "op5_warc": warc.ORACLE}
