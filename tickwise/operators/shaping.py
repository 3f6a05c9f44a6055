"""Output shaping.

Emitting every row with NULLs (O29, V12) is the identity; these operators
give the alternate shapes: warm-up trimming, NaN/NULL filling, the tidy long
form, and one nested document per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def warmup_rows(indicator: str, params: dict) -> int:
    """V13 thresholds: rows to drop at the head of each series."""
    ind = indicator.lower()
    if ind in ("sma", "ema"):
        return int(params.get("window", 20)) - 1
    if ind == "bollinger":
        return int(params.get("period", 20)) - 1
    if ind == "rsi":
        return int(params.get("period", 14))
    if ind == "macd":
        return int(params.get("slow_period", 26)) - 1
    raise ValueError(f"unknown indicator {indicator}")


def trim_warmup(df: DataFrame, skip: int, keys=("symbol",), order="date") -> DataFrame:
    """Keep rows whose 0-based position in their series is >= ``skip``;
    positions come from counts per (series, year), see ``kernels.in_blocks``."""
    if skip <= 0:
        return df
    marked = K.in_blocks(df.withColumn("__one", F.lit(1)), "__one", keys, order)
    return K.out_of_blocks(marked.where(F.col(K.POSITION) >= skip)).drop("__one")


def fill_missing(df: DataFrame, columns, value: float = 0.0) -> DataFrame:
    """NaN or NULL becomes ``value`` (MACD and Bollinger in the alternate
    endpoints)."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")),
                                         F.lit(float(value))) for c in columns})


def to_long(df: DataFrame, value_columns, ids=("symbol", "date"),
            name: str = "indicator", value: str = "value") -> DataFrame:
    """One row per (series point, indicator) with a generic value column.
    NULL values are kept, as the point documents keep them."""
    return df.unpivot(list(ids), list(value_columns), name, value)


def documents(points: DataFrame, point_columns, order: str = "date") -> DataFrame:
    """One response document per request: symbol, indicator, parameters
    (numbers by name), ``data_points``, the clamped range and the ordered
    points.

    ``points`` has the header columns (request_id, symbol, indicator,
    parameters, start_date, end_date) on every row. A document is as long as
    one request's range, which is bounded by its calendar days, so collecting
    its points is safe; the aggregation itself is a normal shuffle. Where the
    points of a request are one row's array already (column ``points``), whole
    arrays are put together, and a request that comes once keeps its own.
    """
    head = ["request_id", "symbol", "indicator", "parameters", "start_date", "end_date"]
    if "points" in points.columns:
        data = F.transform(F.flatten("__all"), lambda p: F.struct(p[order].alias("date"), *[p[c].alias(c) for c in point_columns]))
        docs = points.groupBy(*head).agg(F.collect_list("points").alias("__all")).select(*head, F.sort_array(data).alias("data"))
        return docs.select(*head, F.size("data").cast("long").alias("data_points"), "data")
    point = F.struct(F.col(order).alias("date"), *[F.col(c) for c in point_columns])
    return points.groupBy(*head).agg(
        F.count(F.lit(1)).alias("data_points"), F.sort_array(F.collect_list(point)).alias("data"))


def documents_json(docs: DataFrame) -> DataFrame:
    """Text form of the documents (dates ISO, NULL values kept as null)."""
    head = ["symbol", "indicator", "parameters", "data_points", "start_date", "end_date", "data"]
    return docs.select("request_id", F.to_json(F.struct(*head), {"ignoreNullFields": "false"}).alias("document"))
