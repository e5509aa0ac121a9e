"""Builds the SQL that the checker runs beside each query."""

from __future__ import annotations

from concord.sources.shaped import checker_sql


def check(shapes: list[str], body: str, ctes: dict[str, str] | None = None) -> str:
    """``WITH`` the shaped inputs and any helper CTEs, followed by the body."""
    parts = [f"{name} AS ({checker_sql(name)})" for name in shapes]
    parts += [f"{name} AS ({text.strip()})" for name, text in (ctes or {}).items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def half_up(expr: str, digits: int) -> str:
    """Round a double half away from zero on its decimal spelling, as Spark does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
