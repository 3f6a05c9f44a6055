"""Bars source and sink.

The bars table is read lazily; nothing is resident. Filters and column
selections written after ``read_bars`` reach the parquet scan
(``PushedFilters`` / ``ReadSchema``), so one symbol or one year costs one
symbol's or one year's row groups, not the whole table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..schema import require_columns

YEAR = "bar_year"
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def normalise_dates(df: DataFrame, columns=("date",)) -> DataFrame:
    """O2: timestamp columns become dates; other types are left alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if c in types and isinstance(types[c], _TIMESTAMPS):
            df = df.withColumn(c, F.to_date(F.col(c)))
    return df


def read_bars(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """O1: scan a bars table (a file or a partitioned folder). A table written
    by ``write_bars`` with its years apart is read so that date filters leave
    out whole folders: the year column is tied to the date."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = normalise_dates(reader.parquet(path))
    return require_columns(df, "symbol", "date", "close")


def sorted_layout(df: DataFrame, keys=("symbol",), order: str = "date",
                  partitions: int | None = None) -> DataFrame:
    """O3: range-partition and sort by (symbol, date): a hot symbol spans partitions.

    This is the write-side layout; readers never need a global sort because
    every series window sorts within its own partition.
    """
    parts = [partitions] if partitions else []
    return df.repartitionByRange(*parts, *keys, order).sortWithinPartitions(*keys, order)


def write_bars(df: DataFrame, path: str, mode: str = "overwrite", by_year: bool = False) -> None:
    """Parquet sink in the sorted layout; ``by_year`` puts each year into a
    folder of its own (column ``YEAR``), which ``series.in_range`` prunes by."""
    if not by_year:
        sorted_layout(df).write.mode(mode).parquet(path)
        return
    df = df.withColumn(YEAR, F.year("date"))
    laid_out = df.repartitionByRange(YEAR, "symbol", "date").sortWithinPartitions(YEAR, "symbol", "date")
    laid_out.write.mode(mode).partitionBy(YEAR).parquet(path)


# --- stored blocks ----------------------------------------------------------------

_LAYOUT = "buckets int, halo int, columns string"


def write_blocks(bars: DataFrame, path: str, halo: int = 199, buckets: int | None = None, col: str = "close") -> None:
    """Store bars for the series windows: cut into blocks with their ``halo``
    rows, numbered, bucketed by (symbol, block) and sorted by position, so that
    windows, block ends and their joins read them without an exchange. A hot
    symbol spreads over as many buckets as it has blocks. Bars without a symbol
    belong to no series and are left out. ``halo``: the longest
    window less one (199 serves every window of the endpoints but RSI's
    period + 1, whose bound is 100)."""
    spark = bars.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = K.in_blocks(bars.where(F.col("symbol").isNotNull()), col, halo=halo, dealt=False).drop(K.SERIES)
    marked = marked.withColumn(K.HALO, F.col(K.HALO).alias(K.HALO, metadata={"rows": halo}))
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # of this session; stored files stay
    (marked.repartition(buckets, "symbol", K.BLOCK).write.bucketBy(buckets, "symbol", K.BLOCK).sortBy("symbol", K.BLOCK, K.POSITION)
     .option("path", f"{path}/blocks").format("parquet").saveAsTable(name))
    spark.createDataFrame([(buckets, halo, spark.table(name).schema.json())], _LAYOUT).write.parquet(f"{path}/layout")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Stored blocks, as ``indicators`` take them; another session's table is
    made known to this one by its layout."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()  # one row
        schema = T.StructType.fromJson(json.loads(layout["columns"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol, `{K.BLOCK}`) SORTED BY (symbol, `{K.BLOCK}`, `{K.POSITION}`) "
                  f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/blocks'")
    else:
        layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    blocks = spark.table(name)
    return K.with_series(blocks.withColumn(K.HALO, F.col(K.HALO).alias(K.HALO, metadata={"rows": layout["halo"]})))


def _table(path: str) -> str:
    return f"bar_blocks_{hashlib.md5(path.encode()).hexdigest()[:16]}"
