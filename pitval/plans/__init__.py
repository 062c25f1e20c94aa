"""Registered queries, grouped by area."""
from __future__ import annotations

import importlib

AREAS = ("flagship", "scans", "valuation_queries", "join_queries", "window_queries", "fact_queries", "text_queries",
         "option_queries", "ledger_queries", "signal_queries", "stream_queries")


def all_queries():
    out = {}
    for area in AREAS:
        book = importlib.import_module(f".{area}", __name__).book
        clash = out.keys() & book.items.keys()
        if clash:
            raise ValueError(f"duplicate queries {clash}")
        out.update(book.items)
    return out
