"""Queries over the driver's tables, one for each operator, with SQL that must give the same rows."""

from __future__ import annotations

from .plans import kernels, queries, streams

QUERIES = queries.QUERIES | kernels.QUERIES | streams.QUERIES
ORACLES = queries.ORACLES | kernels.ORACLES | streams.ORACLES
