"""Queries of the training-data operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_template_decontamination": "decontaminate",
    "op2_byte_bpe": "bpe",
    "op3_quality_cascade": "quality",
    "op4_chat_format": "chat",
    "op5_orc_token_ids": "orc_ids",
    "op6_bootstrapped_pii": "pii",
    "op7_ngram_jaccard": "jaccard",
    "op8_zip_warc": "warc",
    "op9_zstd_secrets": "secrets",
    "op10_debruijn_dedup": "substring",
    "op11_punctuated_panes": "panes",
    "op12_trie_repair": "repair",
    "op13_grid_order_join": "vectors",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
