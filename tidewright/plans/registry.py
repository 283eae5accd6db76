"""Where queries register themselves with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep
