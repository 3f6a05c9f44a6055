"""The source guard."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df, *columns: str) -> DataFrame:
    """Source guard: a non-DataFrame is a TypeError, a missing column a
    ValueError naming it. Runs on the schema only, before any job."""
    if not isinstance(df, DataFrame):
        raise TypeError("expected a pyspark DataFrame, got %s" % type(df).__name__)
    present = set(df.columns)
    for c in columns:
        if c not in present:
            raise ValueError(f"no column {c!r} in {sorted(present)}")
    return df
