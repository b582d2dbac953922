"""All registered queries: name to (function of session and data folder, SQL or None)."""

from __future__ import annotations

from tariffa.plans import capture_queries, flow_queries, panel_queries, quote_queries


def all_queries() -> dict:
    out = {}
    for part in (panel_queries, quote_queries, capture_queries, flow_queries):
        clash = set(out) & set(part.Q)
        if clash:
            raise ValueError(f"query names used twice: {clash}")
        out.update(part.Q)
    return out
