"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_repetition",
    "op2_html",
    "op3_pii",
    "op4_license_scan",
    "op5_bpe",
    "op6_ngram_join",
    "op7_token_binary",
    "op8_radix_dedup",
    "op9_suffix_tree_lm",
    "op10_mixing",
)


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").SQL
    return out
