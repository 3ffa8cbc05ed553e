"""All registered queries of the engine: name -> (query, SQL it must agree with or None)."""

from __future__ import annotations

from . import browse, bundle, discovery, evidence, graph, kg, prose, records, relational, reports, resolution, rules, streaming, text


def registered() -> dict:
    found: dict = {}
    for module in (evidence, records, kg, reports, prose, browse, relational, text, resolution, graph, bundle, discovery, rules, streaming):
        found |= module.QUERIES
    return found
