"""All queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "secret_scan",
    "minhash_dedup",
    "sentencepiece_sample",
    "quality_classifier",
    "chat_format",
    "decontaminate",
    "pii_pseudonyms",
    "quality_rules",
    "license_scan",
    "html_extract",
)


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"lodestore.llm.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
