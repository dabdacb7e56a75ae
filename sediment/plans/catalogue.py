"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from sediment.plans import corpora, formats, routing

QUERIES = routing.QUERIES | corpora.QUERIES | formats.QUERIES
ORACLES = routing.ORACLES | corpora.ORACLES | formats.ORACLES
