"""Range index of bars for batch evaluation.

One row per (symbol, year) holds that year's dates and closes as arrays in date
order. The index is built once, by one shuffle of the bars, and every request
reads it: a request takes the slices of the years that its range touches. A
range's bars are then one row, bounded by its calendar days; ``functions.ranges``
gives the points of many such rows at once. No window frame is collected, and
parameters may differ by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges as N
from ..session import scratch_path


def range_index(bars: DataFrame) -> DataFrame:
    """The index of ``bars`` (symbol, date, close; symbol and date unique) as a
    lazy plan: one exchange, by (symbol, year)."""
    b = bars.select("symbol", F.year("date").alias("bar_year"), F.struct(F.col("date").alias("d"), F.col("close").alias("x")).alias("row"))
    # Dealt out before the aggregate: no list is made twice.
    years = b.repartition("symbol", "bar_year").groupBy("symbol", "bar_year").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return years.select("symbol", "bar_year", F.size("rows").cast("long").alias("n"), F.col("rows.d").alias("d"), F.col("rows.x").alias("x"))


def write_index(bars: DataFrame, path: str) -> None:
    """Store the index: a folder per year, sorted by symbol."""
    range_index(bars).sortWithinPartitions("bar_year", "symbol").write.partitionBy("bar_year").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_index(bars: DataFrame) -> DataFrame:
    """The index in a scratch table, so that all of a query's reads share it."""
    spark = bars.sparkSession
    path, lazy = scratch_path(spark, "range-index"), range_index(bars)
    lazy.write.parquet(path)
    return spark.read.schema(lazy.schema).parquet(path)


# --- slices -----------------------------------------------------------------------


def slices(ranges: DataFrame, index: DataFrame, start_col: str, end_col: str, keys: list[str]) -> DataFrame:
    """``ranges`` (told apart by ``keys``) with ``d`` and ``x``: the dates and
    closes that each holds, in order. An open end (NULL) reaches to the first or
    last bar; ranges without bars are left out.

    The join is on (symbol, year) between two stored or scanned tables, so
    adaptive execution can split a hot symbol's ranges.
    """
    years = index.agg(F.struct(F.min("bar_year").alias("low"), F.max("bar_year").alias("high")).alias("y")).scalar()
    s, e = F.col(start_col), F.col(end_col)
    low = F.greatest(F.coalesce(F.year(s), years["low"]), years["low"])
    high = F.least(F.coalesce(F.year(e), years["high"]), years["high"])
    asked = ranges.withColumns({"__low": low, "__high": high}).where((F.col("__low") <= F.col("__high")) & (s.isNull() | e.isNull() | (s <= e)))
    asked = asked.withColumn("bar_year", F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")
    met = asked.join(index, ["symbol", "bar_year"])
    # Dates are sorted: what stands before the range, and up to its end.
    before = F.when(s.isNotNull() & (F.year(s) == F.col("bar_year")), F.size(F.filter("d", lambda x: x < s))).otherwise(0)
    upto = F.when(e.isNotNull() & (F.year(e) == F.col("bar_year")), F.size(F.filter("d", lambda x: x <= e))).otherwise(F.col("n")).cast("int")
    met = met.withColumns({"__from": before, "__upto": upto}).where(F.col("__upto") > F.col("__from"))
    of = lambda a: F.slice(a, F.col("__from") + 1, F.col("__upto") - F.col("__from")).alias(a)
    own = [c for c in ranges.columns if c not in ("symbol", start_col, end_col, *keys)]
    met = met.select(*keys, *own, F.struct("bar_year", of("d"), of("x")).alias("b"))
    parts = met.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in own], F.sort_array(F.collect_list("b")).alias("b"))
    return parts.select(*keys, *own, F.flatten("b.d").alias("d"), F.flatten("b.x").alias("x"))


def index_range(index: DataFrame):
    """First and last date of an index, from one scalar subquery."""
    ends = index.agg(F.struct(F.min(F.get("d", F.lit(0))).alias("first"), F.max(F.element_at("d", -1)).alias("last")).alias("r")).scalar()
    return ends["first"], ends["last"]


def counts(ranges: DataFrame, index: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """(symbol, start, end, ``points``): bars of each distinct range, from the
    years' counts; only the years at its ends are looked into."""
    s, e, year = F.col(start_col), F.col(end_col), F.col("bar_year")
    spread = ranges.where(s <= e).withColumn("bar_year", F.explode(F.sequence(F.year(s), F.year(e))))
    met = spread.join(index.select("symbol", "bar_year", "d", "n"), ["symbol", "bar_year"])
    inside = F.when((year > F.year(s)) & (year < F.year(e)), F.col("n")).otherwise(F.size(F.filter("d", lambda x: x.between(s, e))))
    return met.groupBy("symbol", start_col, end_col).agg(F.sum(inside).alias("points"))


# --- points -----------------------------------------------------------------------


def points(found: DataFrame, columns, nested: bool = False) -> DataFrame:
    """The points of ranges with their slices (ids, indicator, p1, p2, p3, k, d,
    x), for each of the ids; see ``functions.ranges.points``."""
    values = [f"{c} double" for c in columns]
    schema = f"request_id long, points array<struct<{', '.join(['date: date', *[v.replace(' ', ': ') for v in values]])}>>" if nested else ", ".join(["request_id long, date date", *values])
    return found.select("ids", "indicator", "p1", "p2", "p3", "k", "d", "x").mapInArrow(N.points(tuple(columns), nested), schema)
