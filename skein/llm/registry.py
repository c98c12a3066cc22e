"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: The modules in the operators' order.
MODULES = ("sharding", "warc", "bpe", "mixing", "suffix_dedup", "mtree", "line_dedup", "quality", "simhash", "lm_scoring", "whitening", "alignment", "decontamination")


def _all(what: str) -> dict:
    return {k: v for name in MODULES for k, v in getattr(import_module(f"skein.llm.{name}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
