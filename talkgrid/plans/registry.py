"""The registered queries and their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def fold_sql(base: str, joins: str, states: dict[str, tuple[str, str]]) -> str:
    """A recursive CTE `fold` over base(recording_id, rn from 1): grp from 0, and states {name: (when a group begins, when a row joins)}; f is the row before, b this one."""
    first = ", ".join(f"{a.replace('b.', '')} AS {n}" for n, (a, _) in states.items())
    after = ", ".join(f"CASE WHEN {joins} THEN {c} ELSE {a} END" for a, c in states.values())
    return f"""fold AS (SELECT *, 0 AS grp, {first} FROM {base} WHERE rn = 1
  UNION ALL SELECT b.*, CASE WHEN {joins} THEN f.grp ELSE f.grp + 1 END, {after} FROM fold f JOIN {base} b ON b.recording_id = f.recording_id AND b.rn = f.rn + 1)"""
