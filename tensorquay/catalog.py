"""All queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import bitmaps, calibration, containers, content, intervals, ranking, scalars, sessions, slots, storage, tensors, trees
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "bitmaps", "calibration", "containers", "content", "intervals", "ranking", "scalars", "sessions", "slots", "storage", "tensors", "trees"]
