"""Helpers of the registered queries: both engines show doubles to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of summing does not show."""
    names = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return df.select(*[F.round(c, PLACES).alias(c) if c in names else F.col(c) for c in df.columns])


def R(expr: str, name: str | None = None) -> str:  # noqa: N802
    """SQL text of a double to 6 places (and no negative zero)."""
    return f"(round({expr}, {PLACES}) + 0.0) AS {name or expr}"
