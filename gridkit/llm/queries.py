"""Registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import (bin_completion, centroid_matrix, exact_dedup, line_runs, lsh_forest, pairwise_quality, qgram_decontam,
               retrieval_packing, revisits, secret_lexer, shard_tree, token_rollups, trie_pairs)

QUERIES = {
    "op1_fuse_snapshots": exact_dedup.query,
    "op2_shard_tree": shard_tree.query,
    "op3_pairwise_quality": pairwise_quality.query,
    "op4_token_rollups": token_rollups.query,
    "op5_retrieval_packing": retrieval_packing.query,
    "op6_line_runs": line_runs.query,
    "op7_secret_lexer": secret_lexer.query,
    "op8_revisits": revisits.query,
    "op9_qgram_bands": qgram_decontam.query,
    "op10_lsh_forest": lsh_forest.query,
    "op11_trie_pairs": trie_pairs.query,
    "op12_centroid_matrix": centroid_matrix.query,
    "op13_bin_completion": bin_completion.query,
}

ORACLE = {
    "op1_fuse_snapshots": exact_dedup.ORACLE,
    "op6_line_runs": line_runs.ORACLE,
    "op8_revisits": revisits.ORACLE,
    "op11_trie_pairs": trie_pairs.ORACLE,
    "op12_centroid_matrix": centroid_matrix.ORACLE,
}
