"""The registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from tessitura.plans import events, frames, machines, notation

_ALL = {**events.QUERIES, **frames.QUERIES, **notation.QUERIES, **machines.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
