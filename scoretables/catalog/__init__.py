"""Queries that run the operators over the bound tables, each with the SQL that checks it."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _m in ("pitch", "text", "stats", "votes", "windows", "joins", "timeline", "midi", "beats", "structure", "book", "sources"):
    import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
