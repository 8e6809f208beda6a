"""Queries and SQL of this subpackage."""

from __future__ import annotations

from emberline.llm import bpe, exact_dedup, html_text, lang_id, mixing, prefix_trie, quality, sharding, simhash, spelling, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_lang_id": lang_id.op1_lang_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality": quality.op6_quality,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_spelling": spelling.op12_spelling,
    "op13_html_text": html_text.op13_html_text,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL}
