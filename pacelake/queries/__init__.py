"""Named queries over the given tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES

for _name in ("histories", "player_table", "pointintime", "aggregates", "scalars", "relational", "reconstruction", "features", "evaluating", "decisions", "protocols", "integrity", "streams", "feeds", "live", "rich", "identities", "rosters", "calibration"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
