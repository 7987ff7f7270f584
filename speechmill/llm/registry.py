"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["toolcalls", "ngram_join", "pii", "decontam", "quality", "html_text", "bpe", "langid", "lines", "fingerprint"]


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"speechmill.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
