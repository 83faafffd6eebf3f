"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from trailmark.llm import bpe, langid, lines, media, packing, repair, sharding, simhash, spelling, substrings, topk, toxicity, trie

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_ball_tree_top_k": topk.op2_ball_tree_top_k,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_bpe_automaton": bpe.op4_bpe_automaton,
    "op5_fuzzy_line_dedup": lines.op5_fuzzy_line_dedup,
    "op6_repair_token_files": repair.op6_repair_token_files,
    "op7_lpt_sharding": sharding.op7_lpt_sharding,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_language_id": langid.op9_language_id,
    "pipeline": corpus_pipeline.run,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE_SQL = {"op2_ball_tree_top_k": topk.ORACLE_SQL, "op8_substring_dedup": substrings.ORACLE_SQL, "op12_conversation_trie": trie.ORACLE_SQL}
