"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

_PARTS = ["split_queries", "pair_queries", "overlap_queries", "text_queries", "response_queries"]

QUERIES: dict = {}
SQL: dict = {}
for _name in _PARTS:
    _part = importlib.import_module(f"tarnwise.llm.{_name}")
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
