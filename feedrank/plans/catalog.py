"""All registered queries."""

from __future__ import annotations


def all_queries() -> dict:
    from . import core_queries, feed_queries, name_queries, report_queries, stream_queries

    modules = (core_queries, name_queries, report_queries, feed_queries, stream_queries)
    out: dict = {}
    for module in modules:
        out.update(module.QUERIES)
    return out
