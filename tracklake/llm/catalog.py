"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import archives, codes, decontaminate, divergence, langid, lines, minhash, mixing, neighbours, packing, repeats, resharding, toxicity

MODULES = [minhash, packing, decontaminate, archives, mixing, toxicity, neighbours, resharding, lines, repeats, divergence, codes, langid]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
