"""The five indicators and the suite.

Each function takes a bars-shaped DataFrame that is *already* restricted to
the requested symbols and dates (V1: the range filter comes first; see
``tickwise.operators.series.series``) and returns it with the indicator
columns added, for every series at once. Nothing is collected. Long series are
cut into blocks with a halo (``kernels.in_blocks``), so a symbol spreads over
as many tasks as it has blocks; ``whole=True`` keeps each series in one task,
for series of bounded length. A table of stored blocks (``sources.read_blocks``)
is taken as it is: its rows stand where the windows need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.kernels import first_difference, gain, loss, rolling_mean, rolling_std, trailing
from ..schema import require_columns

# Defaults and bounds of the live endpoints.
DEFAULTS = {
    "sma": {"window": 20},
    "ema": {"window": 20},
    "rsi": {"period": 14},
    "macd": {"fast_period": 12, "slow_period": 26, "signal_period": 9},
    "bollinger": {"period": 20, "std_dev": 2.0},
}


def _marked(df: DataFrame, col: str, keys, order, halo: int, whole: bool) -> DataFrame:
    require_columns(df, col)
    if K.is_marked(df):
        if K.stored_halo(df) is not None and K.stored_halo(df) < halo:
            raise ValueError(f"stored blocks have {K.stored_halo(df)} rows of the block before, {halo} are needed")
        return df
    return K.in_one_pass(df, col, keys, order) if whole else K.in_blocks(df, col, keys, order, halo)


def _window(keys, order, whole: bool):
    return K.series_window(keys, K.POSITION) if whole else K.block_window(keys)


def sma(df: DataFrame, window: int = 20, keys=("symbol",), order="date",
        col: str = "close", out: str = "sma", whole: bool = False) -> DataFrame:
    """Simple moving average over the last ``window`` rows (min 1)."""
    df = _marked(df, col, keys, order, window - 1, whole)
    return K.out_of_blocks(df.withColumn(out, rolling_mean(col, window, _window(keys, order, whole))))


def ema(df: DataFrame, window: int = 20, keys=("symbol",), order="date",
        col: str = "close", out: str = "ema", whole: bool = False) -> DataFrame:
    """Exponential mean, alpha = 2/(window+1), seeded by the first value."""
    df = _marked(df, col, keys, order, 0, whole)
    return K.out_of_blocks(K.ewm_means(df, [(col, window, out)], keys, order=order))


def _rsi_columns(df: DataFrame, period: int, w, col: str, out: str, diff_col: str = "__diff") -> DataFrame:
    df = df.withColumn(diff_col, first_difference(col, w))
    ag = F.avg(gain(F.col(diff_col))).over(trailing(w, period))
    al = F.avg(loss(F.col(diff_col))).over(trailing(w, period))
    df = df.withColumns({"__avg_gain": ag, "__avg_loss": al})
    g, lo = F.col("__avg_gain"), F.col("__avg_loss")
    # V9: no loss and some gain is 100; no movement at all is undefined (NULL).
    # Spelled out so ANSI mode never sees a division by zero.
    value = (F.when(lo > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / lo))
             .when(g > 0, F.lit(100.0)))
    return df.withColumn(out, value).drop(diff_col, "__avg_gain", "__avg_loss")


def rsi(df: DataFrame, period: int = 14, keys=("symbol",), order="date",
        col: str = "close", out: str = "rsi", whole: bool = False) -> DataFrame:
    """RSI from *simple* rolling means of gains and losses (V7, V8)."""
    df = _marked(df, col, keys, order, period, whole)  # a row more: the oldest difference needs it
    return K.out_of_blocks(_rsi_columns(df, period, _window(keys, order, whole), col, out))


def macd(df: DataFrame, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9,
         keys=("symbol",), order="date", col: str = "close",
         out=("macd", "signal", "histogram"), whole: bool = False) -> DataFrame:
    """MACD line, signal (EMA of the line, V6) and histogram.

    Fast and slow means share one pass; the signal reuses its blocks.
    ``fast < slow`` is not required.
    """
    m, s, h = out
    df = _marked(df, col, keys, order, 0, whole)
    df = K.ewm_means(df, [(col, fast_period, "__fast"), (col, slow_period, "__slow")], keys, order=order)
    df = df.withColumn(m, F.col("__fast") - F.col("__slow"))
    df = K.ewm_means(df, [(m, signal_period, s)], keys, order=order)
    return K.out_of_blocks(df.withColumn(h, F.col(m) - F.col(s)).drop("__fast", "__slow"))


def bollinger(df: DataFrame, period: int = 20, std_dev: float | str = 2.0, keys=("symbol",),
              order="date", col: str = "close",
              out=("upper", "middle", "lower"), whole: bool = False) -> DataFrame:
    """middle = SMA, bands = middle +- k * sample deviation (V10, V11);
    ``std_dev`` may name a column that holds k."""
    up, mid, low = out
    df = _marked(df, col, keys, order, period - 1, whole)
    w = _window(keys, order, whole)
    df = df.withColumns({mid: rolling_mean(col, period, w), "__sd": rolling_std(col, period, w)})
    k = F.col(std_dev) if isinstance(std_dev, str) else F.lit(float(std_dev))
    return K.out_of_blocks(df.withColumns({up: F.col(mid) + F.col("__sd") * k,
                                           low: F.col(mid) - F.col("__sd") * k}).drop("__sd"))


def suite(df: DataFrame, sma_window: int = 20, ema_window: int = 20, rsi_period: int = 14,
          macd_periods=(12, 26, 9), bb_period: int = 20, bb_std: float = 2.0,
          keys=("symbol",), order="date", col: str = "close", whole: bool = False,
          state: DataFrame | None = None, means: str | None = None, keep: bool = False) -> DataFrame:
    """All five indicators over all series in one plan.

    Every window shares the partitioning by block; the means of equal windows
    are one column (V11). For rows that follow others (``operators.incremental``):
    ``means`` names the column that exponential means run over, ``state`` what
    they have reached; ``keep`` leaves the columns of ``STATE``.
    """
    fast, slow, sig = macd_periods
    source = means or col
    beside = [c for c in df.columns if c not in (*K.MARKS, *keys)]
    df = _marked(df, source, keys, order, max(sma_window - 1, bb_period - 1, rsi_period), whole)
    w = _window(keys, order, whole)
    rolled = {"sma": rolling_mean(col, sma_window, w), "__sd": rolling_std(col, bb_period, w)}
    if bb_period != sma_window:
        rolled["bb_middle"] = rolling_mean(col, bb_period, w)
    df = df.withColumns(rolled)
    if bb_period == sma_window:
        df = df.withColumn("bb_middle", F.col("sma"))
    k = F.lit(float(bb_std))
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.col("__sd") * k,
                         "bb_lower": F.col("bb_middle") - F.col("__sd") * k}).drop("__sd")
    df = _rsi_columns(df, rsi_period, w, col, "rsi")
    of = lambda outs: None if state is None else state.select(*keys, *outs)
    df = K.ewm_means(df, [(source, ema_window, "ema"), (source, fast, "macd_fast"), (source, slow, "macd_slow")], keys, of(["ema", "macd_fast", "macd_slow"]), order, beside)
    df = df.withColumn("macd", F.col("macd_fast") - F.col("macd_slow"))
    df = K.ewm_means(df, [("macd", sig, "macd_signal")], keys, of(["macd_signal"]), order, beside)
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return K.out_of_blocks(df if keep else df.drop("macd_fast", "macd_slow"))


#: Exponential means that a series has reached.
STATE = ("ema", "macd_fast", "macd_slow", "macd_signal")

SUITE_COLUMNS = ("sma", "ema", "rsi", "macd", "macd_signal", "macd_histogram",
                 "bb_upper", "bb_middle", "bb_lower")
