"""Refusals: a broken input stops the job and names the rows that broke it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class Refused(ValueError):
    """Raised before anything is written; `rows` holds a few of the offending rows."""

    def __init__(self, message: str, rows: list | None = None):
        self.rows = rows or []
        shown = "; ".join(str(r) for r in self.rows)
        super().__init__(f"{message}: {shown}" if shown else message)


def refuse(offending: DataFrame, message: str, show: int = 5) -> None:
    """Raise if `offending` holds any row. Reads no further than the first few."""
    rows = offending.take(show)
    if rows:
        raise Refused(message, rows)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """The table itself, once every named column is known to be there."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise Refused(f"{what} lacks the columns {missing}")
    return df
