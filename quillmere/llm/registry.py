"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from quillmere.llm import ann, decontam, langid, line_dedup, mixing, pii, sharding, simhash, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_sharding": sharding.query,
        "op3_simhash": simhash.query,
        "op4_line_dedup": line_dedup.query,
        "op5_decontamination": decontam.query,
        "op6_mixing": mixing.query,
        "op7_nearest_neighbours": ann.query,
        "op8_sanitisation": pii.query,
        "op9_language_id": langid.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.ORACLE, "op5_decontamination": decontam.ORACLE, "op10_warc": warc.ORACLE}
