"""Queries over the driver tables, by name, with their SQL."""

from __future__ import annotations

from spanmill.queries import cohorts, folds, masks, models, objects, places, rasters, scans, slides, tiles, votes

_PARTS = (masks, cohorts, tiles, votes, objects, folds, rasters, places, scans, slides, models)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
