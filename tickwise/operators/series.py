"""Filters, listings and whole-table statistics over bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import YEAR
from .skew import spread_join


def _date(v):
    if v is None or isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v))


def day_before(v) -> dt.date:
    return _date(v) - dt.timedelta(days=1)


def by_symbol(bars: DataFrame, symbol: str) -> DataFrame:
    """Exact, case-sensitive symbol match (V17); pushed to the scan."""
    return bars.where(F.col("symbol") == F.lit(symbol))


def in_range(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Optional inclusive start and/or end (V2); pushed to the scan. Of a
    table with its years in folders only those of the range are listed."""
    start, end = _date(start), _date(end)
    by_year = YEAR in bars.columns
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start))
        bars = bars.where(F.col(YEAR) >= start.year) if by_year else bars
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end))
        bars = bars.where(F.col(YEAR) <= end.year) if by_year else bars
    return bars


def series(bars: DataFrame, symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Restrict bars to what one request may see, *before* any window (V1)."""
    if symbol is not None:
        bars = by_symbol(bars, symbol)
    return in_range(bars, start, end)


def unknown_symbols(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Requests naming a symbol that has no bars (left anti join on the
    distinct symbol list; a hot symbol's requests are dealt over several tasks)."""
    known = bars.select("symbol").distinct()
    return spread_join(requests, known, ["symbol"], "request_id", "left_anti")


def symbols_distinct(bars: DataFrame) -> DataFrame:
    """O14."""
    return bars.select("symbol").distinct()


def symbols_first_n(bars: DataFrame, n: int = 20) -> DataFrame:
    """The first n symbols in sorted order (top-k, not a global sort)."""
    return symbols_distinct(bars).orderBy("symbol").limit(n)


def date_range(bars: DataFrame) -> DataFrame:
    """One row, min and max date."""
    return bars.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def dataset_info(bars: DataFrame) -> DataFrame:
    """Loaded flag, #symbols, #records and range in one aggregate."""
    return bars.agg(
        F.lit(True).alias("loaded"),
        F.count_distinct("symbol").alias("symbols"),
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def symbol_profile(bars: DataFrame) -> DataFrame:
    """O17 per symbol: row count, range, price extremes, mean close, volume."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.min("low").alias("min_low"),
        F.max("high").alias("max_high"),
        F.avg("close").alias("avg_close"),
        F.sum("volume").alias("total_volume"),
    )


# --- whole tables ---------------------------------------------------------------------

_PROFILE = "struct<position:int,column:string,type:string,records:bigint,nulls:bigint,min_value:string,max_value:string>"


def _measures(df: DataFrame) -> list[Column]:
    """One metric per column and fact, named ``{fact}_{position}``."""
    out = [F.count(F.lit(1)).alias("records")]
    for j, f in enumerate(df.schema):
        ordered = not isinstance(f.dataType, (T.MapType, T.VariantType))
        text = lambda c, ok=ordered: c.cast("string") if ok else F.lit(None).cast("string")
        out += [F.count(df[f.name]).alias(f"count_{j}"), text(F.min(df[f.name]) if ordered else F.lit(None)).alias(f"min_{j}"),
                text(F.max(df[f.name]) if ordered else F.lit(None)).alias(f"max_{j}")]
    return out


def _profile_rows(df: DataFrame, row) -> list[Column]:
    return [F.struct(F.lit(j + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                     row("records").alias("records"), (row("records") - row(f"count_{j}")).alias("nulls"), row(f"min_{j}").alias("min_value"), row(f"max_{j}").alias("max_value"))
            for j, f in enumerate(df.schema)]


def dataset_profile(df: DataFrame) -> DataFrame:
    """O17 for a whole table: a row per column with its place, name, type,
    the table's records, nulls, and least and greatest value as text. One pass
    of partial aggregates, whatever the number of columns."""
    one = df.agg(*_measures(df))
    return one.select(F.inline(F.array(*_profile_rows(df, F.col))))


def observed(df: DataFrame, name: str = "profile") -> tuple[DataFrame, Observation]:
    """``df`` with its profile's metrics attached: whatever job runs over it
    next (a write, say) gathers them on the way. ``profile_of`` reads them."""
    seen = Observation(name)
    return df.observe(seen, *_measures(df)), seen


def profile_of(df: DataFrame, seen: Observation) -> DataFrame:
    """The rows of ``dataset_profile`` from metrics that a job has gathered."""
    got = seen.get
    rows = [(j + 1, f.name, f.dataType.simpleString(), got["records"], got["records"] - got[f"count_{j}"], got[f"min_{j}"], got[f"max_{j}"]) for j, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, _PROFILE[len("struct<"):-1])


def stored_range(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """O15/O16 of a stored table from its files' footers: one row with the
    first and last date and the records. Parquet aggregate pushdown needs the
    second version of the reader, so this is a plan of a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    return own.read.parquet(path).agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("records"))
