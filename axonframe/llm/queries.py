"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import language, leaks, licenses, lines, mixing, neardup, ngrams, pieces, private, quality, spelling, tries, vectors

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_language_id": language.op3_language_id,
    "op4_lm_scoring": ngrams.op4_lm_scoring,
    "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup,
    "op6_embedding_near_dedup": vectors.op6_embedding_near_dedup,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_pii_pseudonyms": private.op9_pii_pseudonyms,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_conversation_trie": tries.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_benchmark_decontamination": leaks.op13_benchmark_decontamination,
}
SQL = {
    "op2_quality_rules": quality.SQL,
    "op5_minhash_near_dedup": neardup.SQL,
    "op6_embedding_near_dedup": vectors.SQL,
    "op7_line_dedup": lines.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_conversation_trie": tries.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_benchmark_decontamination": leaks.SQL,
}
