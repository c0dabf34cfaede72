"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, decontaminate, language_model, pii, quality_classifier, quality_rules, simhash, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_bpe": bpe.op2,
    "op3_token_counts": token_counts.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_toxicity": toxicity.op5,
    "op6_pii": pii.op6,
    "op7_quality_classifier": quality_classifier.op7,
    "op8_language_model": language_model.op8,
    "op9_chat": chat.op9,
    "op10_simhash": simhash.op10,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.oracle(),
}
