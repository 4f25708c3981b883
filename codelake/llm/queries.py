"""The registered queries of the subpackage and their DuckDB oracles."""

from codelake.llm import ann, bpe, chat, classifier, decontaminate, divergence, langid, maxent, minhash, packing, resample, rules, tokens

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_chat_format": chat.op2_chat_format,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_lm_score": maxent.op4_lm_score,
    "op5_language_id": langid.op5_language_id,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_quality_classifier": classifier.op7_quality_classifier,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_ann": ann.op10_ann,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_target_resampling": resample.op13_target_resampling,
}

# operators without an entry cannot be said in SQL; tests/llm compares them by brute force
ORACLE = {
    "op1_minhash": minhash.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op10_ann": ann.OP10_SQL,
    "op11_decontaminate": decontaminate.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
