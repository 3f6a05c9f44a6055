"""Properties and boundary rows, checked against pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tickwise.functions import kernels as K
from tickwise.operators import indicators as I


def _frame(spark, series: dict):
    rows = []
    for sym, closes in series.items():
        for i, c in enumerate(closes):
            rows.append((sym, dt.date(2000, 1, 1) + dt.timedelta(days=i), c))
    random.Random(7).shuffle(rows)  # input order must not matter
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def _by(df, sym, col):
    return [r[col] for r in df.where(df.symbol == sym).orderBy("date").select(col).collect()]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 300, 1300])
@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ewm_block_edges(spark, n, span):
    rng = np.random.default_rng(n * 1000 + span)
    closes = [float(x) for x in np.round(rng.uniform(50, 150, n), 2)]
    out = I.ema(_frame(spark, {"A": closes}), span)
    got = _by(out, "A", "ema")
    want = pd.Series(closes).ewm(span=span, adjust=False).mean().tolist()
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_ewm_crosses_epochs_on_long_series(spark):
    """Series longer than the epoch (4160 rows at span 200, 576 for MACD)."""
    rng = np.random.default_rng(11)
    closes = [float(x) for x in np.round(100 + np.cumsum(rng.normal(0, 1, 9000)), 2)]
    df = _frame(spark, {"L": closes})
    got = _by(I.ema(df, 200), "L", "ema")
    want = pd.Series(closes).ewm(span=200, adjust=False).mean().tolist()
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    m = I.macd(df, 12, 26, 9).where("symbol = 'L'").orderBy("date").toPandas()
    c = pd.Series(closes)
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(m["macd"], line, atol=1e-9)
    assert np.allclose(m["signal"], line.ewm(span=9, adjust=False).mean(), atol=1e-9)


def test_period_one_identities(spark):
    closes = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = _frame(spark, {"A": closes})
    assert _by(I.sma(df, 1), "A", "sma") == closes
    assert _by(I.ema(df, 1), "A", "ema") == closes
    bb = I.bollinger(df, 1, 2.0)
    assert _by(bb, "A", "middle") == closes
    assert _by(bb, "A", "upper") == [None] * 5


def test_constant_series(spark):
    df = _frame(spark, {"C": [7.0] * 70})
    assert set(_by(I.sma(df, 20), "C", "sma")) == {7.0}
    assert np.allclose(_by(I.ema(df, 20), "C", "ema"), 7.0, atol=1e-12)
    assert set(_by(I.rsi(df, 14), "C", "rsi")) == {None}
    bb = I.bollinger(df, 20, 2.0)
    assert _by(bb, "C", "upper")[1:] == [7.0] * 69


def test_rsi_monotone(spark):
    df = _frame(spark, {"UP": [float(i) for i in range(30)], "DN": [float(30 - i) for i in range(30)]})
    out = I.rsi(df, 14)
    up, dn = _by(out, "UP", "rsi"), _by(out, "DN", "rsi")
    assert up[0] is None and set(up[1:]) == {100.0}
    assert dn[0] is None and set(dn[1:]) == {0.0}


def test_macd_equal_periods_is_zero(spark):
    df = _frame(spark, {"A": [float(x) for x in np.sin(np.arange(100)) * 10 + 50]})
    out = I.macd(df, 12, 12, 9)
    assert np.allclose(_by(out, "A", "macd"), 0.0, atol=1e-12)


def test_series_are_independent(spark):
    a = [float(x) for x in range(1, 90)]
    b = [float(x) for x in range(200, 100, -1)]
    both = I.suite(_frame(spark, {"A": a, "B": b}))
    alone = I.suite(_frame(spark, {"A": a}))
    for c in I.SUITE_COLUMNS:
        x, y = _by(both, "A", c), _by(alone, "A", c)
        assert [round(v, 9) if v is not None else None for v in x] == \
               [round(v, 9) if v is not None else None for v in y]


def test_null_close_skipped_by_ewm(spark):
    df = _frame(spark, {"A": [1.0, None, 3.0, 4.0]})
    got = _by(I.ema(df, 3), "A", "ema")
    assert got[1] is None
    # over the non-null values 1, 3, 4 with a = 0.5
    assert got[0] == 1.0 and got[2] == pytest.approx(2.0) and got[3] == pytest.approx(3.0)


def test_rolling_frames_count_rows(spark):
    # gaps in the calendar do not change a row frame
    rows = [("A", dt.date(2000, 1, 1), 1.0), ("A", dt.date(2000, 3, 1), 3.0),
            ("A", dt.date(2001, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    w = K.series_window()
    got = [r[0] for r in df.select(K.rolling_mean("close", 2, w)).orderBy("date").collect()]
    assert sorted(got) == [1.0, 2.0, 4.0]


def test_ewm_keeps_all_history_down_to_underflow(spark):
    """A crash long ago is still seen: over three blocks, then to zero."""
    closes = [1e18] + [0.0] * 2000
    got = _by(I.ema(_frame(spark, {"A": closes}), 20), "A", "ema")
    want = pd.Series(closes).ewm(span=20, adjust=False).mean().tolist()
    assert want[1500] > 0 and np.allclose(got, want, rtol=1e-9, atol=0)


def test_nan_stays_in_the_mean(spark):
    closes = [1.0] * 3 + [float("nan")] + [2.0] * 1500
    got = _by(I.ema(_frame(spark, {"A": closes}), 9), "A", "ema")
    assert all(np.isnan(got[3:])) and got[2] == pytest.approx(1.0)


def test_null_runs_over_blocks(spark):
    rng = np.random.default_rng(2)
    closes = [float(x) if rng.random() > 0.6 else None for x in rng.uniform(50, 150, 3000).round(2)]
    got = _by(I.ema(_frame(spark, {"A": closes}), 30), "A", "ema")
    kept = [c for c in closes if c is not None]
    want = iter(pd.Series(kept).ewm(span=30, adjust=False).mean().tolist())
    for c, g in zip(closes, got):
        assert g is None if c is None else g == pytest.approx(next(want), abs=1e-9)


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1600])
def test_rolling_over_block_edges(spark, n):
    rng = np.random.default_rng(n)
    closes = [float(x) for x in rng.integers(50, 150, n)]
    df, c = _frame(spark, {"A": closes}), pd.Series(closes)
    assert np.allclose(_by(I.sma(df, 200), "A", "sma"), c.rolling(200, min_periods=1).mean(), atol=1e-9)
    d = c.diff()
    up, down = d.clip(lower=0).fillna(0).rolling(14, min_periods=1).mean(), (-d).clip(lower=0).fillna(0).rolling(14, min_periods=1).mean()
    want = [None if u == 0 and v == 0 else 100.0 if v == 0 else 100 - 100 / (1 + u / v) for u, v in zip(up, down)]
    for g, w in zip(_by(I.rsi(df, 14), "A", "rsi"), want):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, abs=1e-9))
    assert np.allclose([x or 0 for x in _by(I.bollinger(df, 600), "A", "middle")], c.rolling(600, min_periods=1).mean(), atol=1e-9)


def test_tie_break_columns_order_equal_dates(spark):
    rows = [("A", dt.date(2000, 1, 1), 2, 5.0), ("A", dt.date(2000, 1, 1), 1, 1.0), ("A", dt.date(2000, 1, 2), 1, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, n int, close double")
    got = {(r["date"].day, r["n"]): r["sma"] for r in I.sma(df, 2, order=("date", "n")).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 3.0, (2, 1): 4.0}


def test_whole_series_equal_blocked_ones(spark):
    rng = np.random.default_rng(5)
    df = _frame(spark, {"A": [float(x) for x in rng.integers(50, 150, 1300)], "B": [float(x) for x in rng.integers(1, 9, 40)]})
    a = I.suite(df).orderBy("symbol", "date").toPandas()
    b = I.suite(df, whole=True).orderBy("symbol", "date").toPandas()
    for c in I.SUITE_COLUMNS:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True)
