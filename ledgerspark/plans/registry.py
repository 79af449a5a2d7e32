"""Registry of queries: a function of (spark, sf_dir) and the SQL with the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..sources.adapter import Ledger, ledger_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _values(rows, names: str) -> str:
    def lit(v):
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"{names} as (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


VIEWS = {
    "asientos": lambda: f"asientos as ({ledger_sql('asientos')})",
    "lineas": lambda: f"lineas as ({ledger_sql('lineas')})",
    "cuentas": lambda: _values(schema.ACCOUNTS, "cuentas(codigo, nombre, tipo, regimen, casilla)"),
    "casillas": lambda: _values([(i, *b) for i, b in enumerate(schema.BOXES)], "casillas(orden, casilla, etiqueta, grupo, resta)"),
}


def query(name: str, sql: str | None = None, views: str = "asientos"):
    """Register a function of the ledger. `views` names the ledger views that the SQL reads; they are put before it."""
    def add(f: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql is not None:
            head = ", ".join(VIEWS[v]() for v in views.split()) if views else ""
            body = sql.strip()
            SQL[name] = (f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}") if head else body
        return f

    return add
