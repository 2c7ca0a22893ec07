"""The corpus queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, exact_dedup, fill_in_middle, language_id, mixing, ngram_join, packing, secret_scan, suffix_dedup, topk_search, toxicity, vector_packing, whitening

QUERIES = {
    "op4_packing": packing.query,
    "op1_topk_search": topk_search.query,
    "op6_mixing": mixing.query,
    "op8_language_id": language_id.query,
    "op2_toxicity": toxicity.query,
    "op3_secret_scan": secret_scan.query,
    "op9_bpe": bpe.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_vector_packing": vector_packing.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_whitening": whitening.query,
}

SQL = {
    "op1_topk_search": topk_search.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_ngram_jaccard_join": ngram_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
}
