"""Every query of the library outside plumbline.llm, with the SQL that states its rows."""

from __future__ import annotations

from plumbline.plans import estimation, gating, geometry, live, pairs, recordings, reports, streams, sync

_PARTS = (geometry, gating, sync, estimation, pairs, reports, streams, live, recordings)

QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
