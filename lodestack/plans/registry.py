"""All queries of the core with their SQL; problem 2 is among them."""

from __future__ import annotations

from lodestack.operators import references
from lodestack.plans import base, events, graphs, records, searching, strategies

BOOKS = (searching.book, records.book, graphs.book, strategies.book, base.book, events.book)


def queries() -> dict:
    return {**references.QUERIES, **{k: q for b in BOOKS for k, q in b.queries.items()}}


def oracles() -> dict:
    return {**references.ORACLES, **{k: q for b in BOOKS for k, q in b.oracles.items()}}
