"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, fill_in_middle, html_text, language_id, licences, mixing, ngram_join, pii, quality_rules, sentencepiece_codec, substring_dedup, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_personal_data": pii.op3_personal_data,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_main_text": html_text.op5_main_text,
    "op6_licence_scan": licences.op6_licence_scan,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_language_id": language_id.op8_language_id,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_benchmark_decontamination": decontamination.op12_benchmark_decontamination,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_licence_scan": licences.SQL,
    "op7_ngram_jaccard_join": ngram_join.SQL,
    "op10_mix_sources": mixing.SQL,
    "op12_benchmark_decontamination": decontamination.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
