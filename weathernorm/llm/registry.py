"""The queries of the corpus operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, filter_audit, hard_negatives, language, lm_scoring, mixing, near_duplicates, neighbours, packing, pii, quality, token_counts, toxicity


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_near_duplicates": near_duplicates.op2_near_duplicates,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_language": language.op4_language,
        "op5_packing": packing.op5_packing,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_pii": pii.op9_pii,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_lm_scoring": lm_scoring.op13_lm_scoring,
    }


def oracle_sql():
    return {"op6_decontamination": decontamination.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
