"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import importlib.util

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in ("queries_records", "queries_overlaps", "queries_texts", "sql_records"):
    _name = f"boxloom.llm.{_part}"
    if importlib.util.find_spec(_name):
        _module = importlib.import_module(_name)
        QUERIES |= getattr(_module, "QUERIES", {})
        SQL |= getattr(_module, "SQL", {})
