"""The numbered queries and their SQL."""

from __future__ import annotations

from trackloom.llm import ann, decontam, jaccard, lines, lm, mixing, oracles, periodic, quality, sharding, suffixes, urls, warc, whiten

QUERIES = {
    "op1_winnowing": decontam.op1_winnowing,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_jump_sharding": sharding.op5_jump_sharding,
    "op6_warc": warc.op6_warc,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_url_rules": urls.op8_url_rules,
    "op9_additive_ann": ann.op9_additive_ann,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_whitening": whiten.op11_whitening,
    "op12_trie_lm": lm.op12_trie_lm,
    "op13_periodic": periodic.op13_periodic,
}
SQL = {
    "op1_winnowing": decontam.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_jaccard": oracles.OP4,
    "op5_jump_sharding": oracles.OP5,
    "op6_warc": oracles.OP6,
    "op8_url_rules": urls.OP8_SQL,
}
