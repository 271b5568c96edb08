"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, near_dup, pii, quality_model, quality_rules, repeats, sentencepieces, token_count, toxicity, warc

QUERIES = {
    "op1_latent_decontamination": decontaminate.op1_latent_decontamination,
    "op2_weak_supervision_pii": pii.op2_weak_supervision_pii,
    "op3_host_quality_rules": quality_rules.op3_host_quality_rules,
    "op4_odd_sketch_near_dup": near_dup.op4_odd_sketch_near_dup,
    "op5_repeated_phrase_automata": repeats.op5_repeated_phrase_automata,
    "op6_transducer_token_count": token_count.op6_transducer_token_count,
    "op7_arc_to_warc": warc.op7_arc_to_warc,
    "op8_kneser_ney_toxicity": toxicity.op8_kneser_ney_toxicity,
    "op9_additive_quality": quality_model.op9_additive_quality,
    "op10_sentencepiece_tokenizers": sentencepieces.op10_sentencepiece_tokenizers,
    "pieces_whole_text_parity": sentencepieces.pieces_whole_text_parity,
}
ORACLES = {
    "op3_host_quality_rules": quality_rules.ORACLE,
    "op4_odd_sketch_near_dup": near_dup.ORACLE,
    "op5_repeated_phrase_automata": repeats.ORACLE,
    "op7_arc_to_warc": warc.ORACLE,
}
