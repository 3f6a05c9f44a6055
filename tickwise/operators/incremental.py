"""The indicator suite on appended bars, from persisted state.

A new day needs the last rows of each series and the exponential means they
have reached, not the history. ``suite_state`` keeps both, one row a symbol:
the last date, the last ``halo`` bars as an array (for the rolling windows)
and the means of ``indicators.STATE``. ``append_suite`` computes the rows that
follow and the state after them; its cost is that of the new rows and of the
states of their symbols. Any number of days may come at once, and symbols may
begin, pause and go on.

A bar on or before its symbol's last date would change rows that are out
already: ``append_suite`` leaves such bars out and ``late_bars`` lists them, to
recompute those symbols from their history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import indicators as I
from .skew import first_n

#: The suite's defaults; the same must be given for all steps of a series.
PARAMETERS = {"sma_window": 20, "ema_window": 20, "rsi_period": 14, "macd_periods": (12, 26, 9), "bb_period": 20, "bb_std": 2.0}
STATE_SCHEMA = "symbol string, last_date date, tail array<struct<date:date,close:double>>, " + ", ".join(f"{c} double" for c in I.STATE)


def tail_rows(parameters: dict = PARAMETERS) -> int:
    """Rows of the past that a new row's windows reach."""
    return max(parameters["sma_window"] - 1, parameters["bb_period"] - 1, parameters["rsi_period"])


def _tails(bars: DataFrame, rows: int) -> DataFrame:
    """(symbol, last_date, tail): the last ``rows`` bars of each symbol."""
    ranked = first_n(bars.select("symbol", "date", "close").withColumns({"__rows": F.lit(rows), "__back": F.datediff(F.lit("1970-01-01").cast("date"), "date")}),
                     ["symbol"], ["__back"], "__rows", "date")
    return ranked.groupBy("symbol").agg(F.max("date").alias("last_date"), F.sort_array(F.collect_list(F.struct("date", "close"))).alias("tail"))


def suite_state(bars: DataFrame, parameters: dict = PARAMETERS, points: DataFrame | None = None) -> DataFrame:
    """The state of every symbol at the end of ``bars``; ``points`` may give
    the suite over them (``keep=True``), if it has been computed."""
    points = I.suite(bars.select("symbol", "date", "close"), **parameters, keep=True) if points is None else points
    return _tails(bars, max(tail_rows(parameters), 1)).join(K.ewm_state(points, I.STATE), "symbol").select("symbol", "last_date", "tail", *I.STATE)


def late_bars(new_bars: DataFrame, state: DataFrame) -> DataFrame:
    """Bars that don't come after their symbol's last date."""
    return new_bars.join(state.select("symbol", "last_date"), "symbol").where(F.col("date") <= F.col("last_date")).select(*new_bars.columns)


def append_suite(new_bars: DataFrame, state: DataFrame, parameters: dict = PARAMETERS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points of the new bars, state after them). Equal to the suite over the
    whole history, cut to the new bars. ``path``: a new folder to store the
    points in at once, with the means of ``indicators.STATE``, so that the state
    is read off them instead of computing them again."""
    rows = max(tail_rows(parameters), 1)
    dated = new_bars.select("symbol", "date", "close").join(state.select("symbol", "last_date"), "symbol", "left")
    fresh = dated.where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).select("symbol", "date", "close", F.lit(True).alias("__new"))
    asked = state.join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    old = asked.select("symbol", F.inline("tail")).select("symbol", "date", "close", F.lit(False).alias("__new"))
    both = old.unionByName(fresh)
    # The tail only feeds the rolling windows: the means go on from the state.
    marked = both.withColumn("__fresh", F.when(F.col("__new"), F.col("close")))
    points = I.suite(marked, **parameters, means="__fresh", state=state, keep=True).where("__new").drop("__new", "__fresh")
    if path is not None:
        points.write.parquet(path)
        points = points.sparkSession.read.schema(points.schema).parquet(path)
    reached = _tails(both, rows).join(K.ewm_state(points, I.STATE), "symbol")
    before = state.select("symbol", *[F.col(c).alias(f"__{c}") for c in I.STATE])
    moved = reached.join(before, "symbol", "left").select("symbol", "last_date", "tail", *[F.coalesce(c, f"__{c}").alias(c) for c in I.STATE])
    still = state.join(fresh.select("symbol").distinct(), "symbol", "left_anti").select(*moved.columns)
    return points.drop("macd_fast", "macd_slow"), still.unionByName(moved)
