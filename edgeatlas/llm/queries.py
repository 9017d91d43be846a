"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from edgeatlas.llm import chat, jaccard, mixing, packing, phrases, pii, quality, substrings, tokens, toxicity, trie, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_embedding_dedup": vectors.op5_embedding_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_phrase_mining": phrases.op11_phrase_mining,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_token_counts": tokens.op13_token_counts,
    "warc_revisits": warc.warc_revisits,
    "mixing_targets": mixing.mixing_targets,
    "embedding_copies": vectors.embedding_copies,
    "pii_base": pii.pii_base,
    "quality_base": quality.quality_base,
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op5_embedding_dedup": vectors.SQL,
    "op9_ngram_jaccard_join": jaccard.SQL,
    "op11_phrase_mining": phrases.SQL,
    "op12_prefix_trie": trie.SQL,
    "warc_revisits": warc.REVISITS_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "embedding_copies": vectors.COPIES_SQL,
    "pii_base": pii.BASE_SQL,
    "quality_base": quality.BASE_SQL,
}
