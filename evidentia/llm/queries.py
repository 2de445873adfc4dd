"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, fill_middle, language, line_dedup, mixing, partenum, pieces, ppm, quality_model, quality_rules, ranked_search, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_classifier": quality_model.op4_quality_classifier,
    "op5_language_id": language.op5_language_id,
    "op6_ngram_jaccard": partenum.op6_ngram_jaccard,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_chat_formatting": chat_format.op8_chat_formatting,
    "op9_lm_scoring": ppm.op9_lm_scoring,
    "op10_warc": warc.op10_warc,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op8_chat_formatting": chat_format.SQL,
    "op10_warc": warc.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
