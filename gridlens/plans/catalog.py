"""All queries of the power-signal engine, by name."""

from __future__ import annotations

from . import generators, matching, models, signal, streams

QUERIES: dict = {**signal.QUERIES, **matching.QUERIES, **models.QUERIES, **streams.QUERIES, **generators.QUERIES}
ORACLE_SQL: dict = {**signal.ORACLE_SQL, **matching.ORACLE_SQL, **models.ORACLE_SQL, **streams.ORACLE_SQL, **generators.ORACLE_SQL}
