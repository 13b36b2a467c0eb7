"""Every query of the library over the given tables, with its SQL."""

from __future__ import annotations

from . import aggregates, audit, facets, facts, joins, mapping, predicates, sampling, sources, text, text_index  # noqa: F401
from .registry import REGISTRY

QUERIES = REGISTRY.queries
ORACLE_SQL = REGISTRY.sql
