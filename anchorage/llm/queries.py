"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of its function of the same name.
MODULES = {
    "op1_token_files": "token_files",
    "op2_toxicity": "toxicity",
    "op3_packing": "packing",
    "op4_media": "media",
    "op5_chat": "chat",
    "op6_langid": "langid",
    "op7_imatch": "imatch",
    "op8_jaccard": "jaccard",
    "op9_pieces": "pieces",
    "op10_licenses": "licenses",
}


def _bound(name: str):
    return lambda spark, sf_dir: getattr(import_module(f".{MODULES[name]}", __package__), name)(spark, sf_dir)


def queries() -> dict:
    return {name: _bound(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {}
