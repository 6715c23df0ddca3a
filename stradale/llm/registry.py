"""The queries of the text operators, and their SQL oracles where SQL can express them."""

from __future__ import annotations

from stradale.llm import decontaminate, html_text, language_id, licenses, near_dups, quality_classifier, quality_rules, sentencepiece, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": near_dups.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_html_extraction": html_text.op3,
    "op4_warc": warc.op4,
    "op5_sentencepiece": sentencepiece.op5,
    "op6_toxicity": toxicity.op6,
    "op7_language_id": language_id.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_license_scan": licenses.op9,
    "op10_quality_classifier": quality_classifier.op10,
}
ORACLES = {
    "op1_ngram_jaccard_join": near_dups.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_warc": warc.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
}
