"""The operators' queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from fieldweave.llm import ann, bpe, chat, collocations, langid, line_dedup, mixing, ngram_join, quality_pu, quality_rules, rlz, topk, trie

_QUERIES = (
    (line_dedup.op1_line_dedup, line_dedup.SQL),
    (ann.op2_additive_quantisation, None),
    (quality_pu.op3_quality_classifier, None),
    (mixing.op4_mixing, mixing.SQL),
    (ngram_join.op5_ngram_join, ngram_join.SQL),
    (bpe.op6_byte_bpe, None),
    (langid.op7_language_id, None),
    (chat.op8_chat, chat.SQL),
    (quality_rules.op9_quality_rules, quality_rules.SQL),
    (rlz.op10_substring_dedup, rlz.SQL),
    (topk.op11_exact_topk, topk.SQL),
    (trie.op12_prefix_trie, trie.SQL),
    (collocations.op13_collocations, collocations.SQL),
)


def queries() -> dict:
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES if sql}
