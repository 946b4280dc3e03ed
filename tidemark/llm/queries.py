"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from tidemark.llm import byte_bpe, fill_in_middle, line_dedup, lm_score, mixing, one_bit_search, ppm_lang, quality_rules, secrets, sharding, simhash, source_audit, url_reputation

QUERIES = {
    "op1_url_reputation": url_reputation.op1_url_reputation,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_one_bit_search": one_bit_search.op3_one_bit_search,
    "op4_pfair_mix": mixing.op4_pfair_mix,
    "op5_rendezvous_shards": sharding.op5_rendezvous_shards,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_ppm_lang": ppm_lang.op9_ppm_lang,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_secret_scan": secrets.op13_secret_scan,
}

#: The others are held against plain Python in tests/llm.
ORACLE_SQL = {
    "op1_url_reputation": url_reputation.ORACLE,
    "op2_lm_score": lm_score.ORACLE,
    "op3_one_bit_search": one_bit_search.ORACLE,
    "op4_pfair_mix": mixing.ORACLE,
    "op5_rendezvous_shards": sharding.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_secret_scan": secrets.ORACLE,
}
