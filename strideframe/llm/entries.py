"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = [
    "quality",
    "exact_dedup",
    "suffix_lm",
    "chat_format",
    "decontaminate",
    "near_dedup",
    "url_filter",
    "byte_bpe",
    "language_id",
    "substring_dedup",
    "lexical_search",
    "spelling",
    "packing",
]


def queries() -> dict:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        if sql := getattr(module, "SQL", None):
            found |= {k: sql for k in vars(module) if k.startswith("op") and k[2:3].isdigit()}
    return found
