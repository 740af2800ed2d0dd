"""What this subpackage registers: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from driftwake.llm import decontaminate, lines, lm, negatives, packing, quality, secrets, sharding, simhash, topk, toxicity, trie, urls

QUERIES = {
    "op1_windows": decontaminate.op1_windows,
    "op2_best_fit": packing.op2_best_fit,
    "op3_entropy": secrets.op3_entropy,
    "op4_maxscore": topk.op4_maxscore,
    "op5_markov": urls.op5_markov,
    "op6_attention": lm.op6_attention,
    "op7_pivots": simhash.op7_pivots,
    "op8_subwords": quality.op8_subwords,
    "op9_virtual_slots": sharding.op9_virtual_slots,
    "op10_deletions": lines.op10_deletions,
    "op11_prefixes": trie.op11_prefixes,
    "op12_weak_labels": toxicity.op12_weak_labels,
    "op13_distance_keys": negatives.op13_distance_keys,
}

ORACLE_SQL = {
    "op1_windows": decontaminate.OP1_SQL,
    "op4_maxscore": topk.OP4_SQL,
    "op10_deletions": lines.OP10_SQL,
    "op11_prefixes": trie.OP11_SQL,
    "op13_distance_keys": negatives.OP13_SQL,
}
