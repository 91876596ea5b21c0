"""Rows out of JSON arrays, and pages of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """One typed row per element of the JSON arrays in ``column``; null and unreadable arrays have none."""
    return df.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def missing_vectors(rows: DataFrame) -> DataFrame:
    """Active rows without an embedding: the work of the backfill, in one distributed pass instead of pages."""
    return rows.where("status_active and embedding is null")
