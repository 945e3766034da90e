"""The queries of this subpackage and their SQL."""

import corpus_pipeline

from . import bpe, chat, decontaminate, langid, language_model, packing, periodic, quality, sharding, simhash, substring, toxicity, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_bpe": bpe.op12_bpe,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
SQL = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
}
