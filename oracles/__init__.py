"""DuckDB oracle SQL for the registered queries (independent SQL formulations)."""

from . import duckdb_sql, prep_sql, rec_sql

ORACLES: dict[str, str] = {**duckdb_sql.ORACLES, **prep_sql.ORACLES, **rec_sql.ORACLES}
