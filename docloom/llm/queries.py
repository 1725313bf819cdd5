"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_template_decontamination": "decontam",
    "op2_pack_sequences": "packing",
    "op3_minhash_near_dup": "near_dup",
    "op4_line_dedup": "line_dedup",
    "op5_warc_roundtrip": "warc",
    "op6_sparse_suffix_dedup": "suffix",
    "op7_quality_rules": "quality_rules",
    "op8_toxicity": "toxicity",
    "op9_chat_format": "chat",
    "op10_language_id": "langid",
    "op11_conversation_repair": "repair",
    "op12_filter_audit": "filter_audit",
    "op13_quality_attention": "quality_mil",
}
_SQL = ("op4_line_dedup", "op5_warc_roundtrip", "op9_chat_format", "op11_conversation_repair", "op12_filter_audit")


def _query(name: str):
    def run(spark, sf_dir: str):
        return getattr(import_module(f"docloom.llm.{_QUERIES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"docloom.llm.{_QUERIES[name]}").SQL for name in _SQL}
