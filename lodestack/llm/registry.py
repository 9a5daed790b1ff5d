"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from lodestack.llm import bpe, mixing, names, neighbours, pairs, scans, toxicity

MODULES = (names, neighbours, scans, pairs, bpe, mixing, toxicity)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
