"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestack.llm import bpe, chat, exact_dedup, filter_audit, language, media, ngram_join, packing, quality, quality_rules, repair, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_packing": packing.op3_packing,
        "op4_bpe": bpe.op4_bpe,
        "op5_warc": warc.op5_warc,
        "op6_chat": chat.op6_chat,
        "op7_language": language.op7_language,
        "op8_quality": quality.op8_quality,
        "op9_media": media.op9_media,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_repair": repair.op11_repair,
        "op12_quality_rules": quality_rules.op12_quality_rules,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op5_warc": warc.SQL, "op11_repair": repair.SQL, "op13_filter_audit": filter_audit.SQL}
