"""The reference's own indicator assertions on its closed-form fixture
(100 days, p(i) = 100 + 0.5 i + 5 sin(0.1 i)), plus its error and edge cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickwise.operators import indicators as I


@pytest.fixture(scope="module")
def aapl(spark):
    rows = []
    for i in range(100):
        p = 100 + 0.5 * i + 5 * math.sin(0.1 * i)
        rows.append(("AAPL", dt.date(2023, 1, 1) + dt.timedelta(days=i), p, p * 1.02, p * 0.98, p,
                     1_000_000 + 10_000 * i))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, "
                                       "low double, close double, volume bigint")


def _col(df, c):
    return [r[c] for r in df.orderBy("date").select(c).collect()]


def test_sma(aapl):
    out = I.sma(aapl, 20)
    vals = _col(out, "sma")
    closes = _col(aapl, "close")
    assert len(vals) == 100 and vals[-1] is not None
    assert vals[-1] == pytest.approx(sum(closes[-20:]) / 20)


def test_ema_differs_from_sma(aapl):
    ema = _col(I.ema(aapl, 20), "ema")
    sma = _col(I.sma(aapl, 20), "sma")
    assert len(ema) == 100 and ema[-1] is not None
    assert ema[-1] != sma[-1]
    assert ema[0] == _col(aapl, "close")[0]


def test_rsi_range(aapl):
    rsi = [v for v in _col(I.rsi(aapl, 14), "rsi") if v is not None]
    assert rsi and all(0 <= v <= 100 for v in rsi)


def test_macd_histogram(aapl):
    out = I.macd(aapl, 12, 26, 9).orderBy("date").collect()
    assert len(out) == 100
    for r in out:
        assert r["histogram"] == pytest.approx(r["macd"] - r["signal"], abs=1e-12)
    assert out[0]["macd"] == 0.0 and out[0]["signal"] == 0.0


def test_bollinger_order(aapl):
    out = I.bollinger(aapl, 20, 2.0).orderBy("date").collect()
    assert out[0]["upper"] is None and out[0]["middle"] == out[0]["close"]
    for r in out[1:]:
        assert r["upper"] > r["middle"] > r["lower"]


def test_missing_close_is_value_error(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "wrong_column bigint")
    with pytest.raises(ValueError, match="close"):
        I.sma(df, 20)


def test_not_a_dataframe_is_type_error():
    with pytest.raises(TypeError):
        I.sma([1, 2, 3], 20)


def test_window_longer_than_series(spark):
    df = spark.createDataFrame([("X", dt.date(2023, 1, 1), 100.0), ("X", dt.date(2023, 1, 2), 105.0)],
                               "symbol string, date date, close double")
    assert _col(I.sma(df, 5), "sma") == [100.0, 102.5]


def test_suite_matches_single_indicators(aapl):
    s = I.suite(aapl).orderBy("date").collect()
    e = I.ema(aapl, 20).orderBy("date").collect()
    r = I.rsi(aapl, 14).orderBy("date").collect()
    for a, b, c in zip(s, e, r):
        assert a["ema"] == pytest.approx(b["ema"], abs=1e-9)
        assert a["rsi"] == c["rsi"]
