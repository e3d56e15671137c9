"""The corpus operators' registered queries and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from functools import partial

from . import conversation_repair, decontaminate, hard_negatives, kneser_ney, line_dedup, mixing, near_dedup, pii, quality_gam, quality_rules, sharding, suffix_dedup, token_counts

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_mix_sources": mixing.query,
    "op5_find_pii": pii.query,
    "op6_quality_rules": quality_rules.query,
    "op7_count_tokens": token_counts.query,
    "op8_quality_gam": quality_gam.query,
    "op9_kneser_ney": partial(kneser_ney.query, order=3),
    "op10_line_dedup": line_dedup.query,
    "op11_virtual_slots": sharding.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_repair_conversations": conversation_repair.query,
}

ORACLES = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_mix_sources": mixing.oracle(),
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_repair_conversations": conversation_repair.ORACLE,
}
