"""Operators for preparing training text, their queries and the SQL that checks them."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _m in ("near_dup", "quality_rules", "bpe", "decontaminate", "licenses", "language", "quality_model", "sharding", "secrets", "substring_dedup", "manifest", "filter_audit", "pii"):
    import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
