"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from panelforge.llm import bpe, chat, divergence, exact_dedup, katz, line_dedup, mixing, packing, quality_rules, simhash, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat": chat.op2_chat,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_katz": katz.op7_katz,
    "op8_substrings": substring_dedup.op8_substrings,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_bpe": bpe.op11_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_divergence": divergence.op13_divergence,
}
SQL = {
    "op2_chat": chat.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op13_divergence": divergence.SQL,
}
