"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, html_text, importance, jaccard_join, line_dedup, mixing, prefix_trie, quality, sentence_pieces, sharding, token_files, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_html_text": html_text.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_byte_bpe": bpe.query,
    "op5_mixing": mixing.query,
    "op6_sharding": sharding.query,
    "op7_quality_rules": quality.query,
    "op8_warc": warc.query,
    "op9_ann": ann.query,
    "op10_token_files": token_files.query,
    "op11_importance": importance.query,
    "op12_sentence_pieces": sentence_pieces.query,
    "op13_prefix_trie": prefix_trie.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op1_line_dedup": line_dedup.SQL, "op3_jaccard_join": jaccard_join.SQL, "op5_mixing": mixing.SQL, "op8_warc": warc.SQL, "op11_importance": importance.SQL, "op13_prefix_trie": prefix_trie.SQL}
