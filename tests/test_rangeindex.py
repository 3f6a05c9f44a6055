"""Batch evaluation from the range index, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwise.operators import rangeindex as RI
from tickwise.operators import requests as RQ

DAYS = [dt.date(1999, 11, 20) + dt.timedelta(days=i) for i in range(1100)]
BARS = "symbol string, date date, close double"
REQUESTS = "request_id long, symbol string, indicator string, params map<string,string>, start_date date, end_date date"


def _series():
    rnd = np.random.default_rng(3)
    return {
        "WALK": 100 + rnd.normal(0, 1, len(DAYS)).cumsum(),
        "GAPS": np.where(rnd.random(len(DAYS)) < 0.2, np.nan, 50 + rnd.normal(0, 3, len(DAYS))),  # null closes
        "JUMP": np.where(np.arange(len(DAYS)) < 300, 1.0, 1e9 + rnd.normal(0, 1e-3, len(DAYS))),  # digits are lost unless it is noticed
        "FLAT": np.full(len(DAYS), 12.1),
    }


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(s, d, None if np.isnan(x) else float(x)) for s, xs in _series().items() for d, x in zip(DAYS, xs)]
    path = str(tmp_path_factory.mktemp("index") / "t")
    RI.write_index(spark.createDataFrame(rows, BARS).repartition(5), path)
    return RI.read_index(spark, path)


def _wanted(x, indicator, p):
    nan = x.isna()
    if indicator == "sma":
        return {"value": x.rolling(p, min_periods=1).mean()}
    if indicator == "ema":
        return {"value": x.dropna().ewm(span=p, adjust=False).mean().reindex(x.index)}
    if indicator == "rsi":
        d = x.diff().fillna(0)
        up, down = d.clip(lower=0).rolling(p, min_periods=1).sum(), (-d).clip(lower=0).rolling(p, min_periods=1).sum()
        return {"value": pd.Series(np.where(down > 1e-12, 100 - 100 / (1 + up / down.where(down > 0)), np.where(up > 1e-12, 100.0, np.nan)), x.index)}
    if indicator == "macd":
        v = x.dropna()
        line = v.ewm(span=p, adjust=False).mean() - v.ewm(span=26, adjust=False).mean()
        return {"macd": line.reindex(x.index), "signal": line.ewm(span=9, adjust=False).mean().reindex(x.index)}
    sd = pd.Series([np.std([v for v in x.iloc[max(0, i - p + 1):i + 1] if v == v], ddof=1) if (~nan.iloc[max(0, i - p + 1):i + 1]).sum() > 1 else np.nan for i in range(len(x))], x.index)
    mean = x.rolling(p, min_periods=1).mean()
    return {"upper": mean + 2 * sd, "middle": mean, "lower": mean - 2 * sd}


NAME = {"sma": "window", "ema": "window", "rsi": "period", "macd": "fast_period", "bollinger": "period"}


def test_all_indicators_over_years_and_windows(spark, stored):
    asked, rid = {}, 0
    for symbol in _series():
        for indicator in NAME:
            for p, a, b in ((1, 0, 50), (2, 30, 41), (20, 40, 1099), (14, 200, 460), (450, 10, 1050), (2000, 700, 1099)):
                rid += 1
                asked[rid] = (symbol, indicator, p, a, b)
    table = [(i, s, ind, {NAME[ind]: str(p)}, DAYS[a], DAYS[b]) for i, (s, ind, p, a, b) in asked.items()]
    out = RQ.evaluate(spark.createDataFrame(table, REQUESTS), index=stored).toPandas()
    groups = dict(tuple(out.groupby("request_id")))
    series = {s: pd.Series(x, DAYS) for s, x in _series().items()}
    for i, (symbol, indicator, p, a, b) in asked.items():
        got = groups[i].sort_values("date").set_index("date")
        assert list(got.index) == DAYS[a:b + 1]
        x = series[symbol].iloc[a:b + 1]
        for column, want in _wanted(x, indicator, p).items():
            mine = got[column].to_numpy(float)
            if symbol == "JUMP":  # the differences of means that pandas takes lose digits themselves
                scale = 1e9 if indicator in ("sma", "ema", "macd") else 1e9 if column == "middle" else None
                if scale is None:
                    continue
                assert np.allclose(mine, want, rtol=1e-9, atol=1e-6 * scale, equal_nan=True), (symbol, indicator, p, a)
                continue
            assert np.allclose(mine, want, rtol=1e-9, atol=1e-8, equal_nan=True), (symbol, indicator, p, a, b, column)


def test_deviations_keep_their_digits_after_a_jump(spark, stored):
    r = [(1, "JUMP", "bollinger", {"period": "20"}, DAYS[0], DAYS[-1]), (2, "FLAT", "bollinger", {"period": "20"}, DAYS[5], DAYS[-1])]
    got = RQ.evaluate(spark.createDataFrame(r, REQUESTS), index=stored).orderBy("request_id", "date").toPandas()
    width = ((got["upper"] - got["lower"]) / 4).to_numpy()
    x = _series()["JUMP"]
    want = [np.std(x[i - 19:i + 1], ddof=1) for i in range(330, len(x))]
    assert np.allclose(width[330:len(x)], want, atol=1e-6)
    assert np.allclose(width[len(x) + 1:], 0, atol=1e-9)


def test_windows_below_one_and_empty_ranges_give_no_points(spark, stored):
    r = [(1, "WALK", "sma", {"window": "0"}, DAYS[0], DAYS[9]), (2, "WALK", "macd", {"signal_period": "-1"}, DAYS[0], DAYS[9]), (3, "WALK", "sma", None, DAYS[9], DAYS[0]),
         (4, "WALK", "sma", None, dt.date(1900, 1, 1), dt.date(1950, 1, 1)), (5, "NONE", "sma", None, None, None), (6, "WALK", "ema", {"window": "x"}, dt.date(1900, 1, 1), DAYS[3])]
    got = RQ.evaluate(spark.createDataFrame(r, REQUESTS), index=stored).groupBy("request_id").count().collect()
    assert {tuple(x) for x in got} == {(6, 4)}


def test_shared_range_is_dealt_over_copies(spark, stored, monkeypatch):
    monkeypatch.setattr(RQ, "SHARED_BY", 10)
    r = spark.range(100).select(F.col("id").alias("request_id"), F.lit("WALK").alias("symbol"), F.lit("sma").alias("indicator"),
                                F.lit(None).cast("map<string,string>").alias("params"), F.lit(DAYS[0]).alias("start_date"), F.lit(DAYS[4]).alias("end_date"))
    got = RQ.evaluate(r, index=stored)
    assert got.count() == 500 and got.select("date", "value").distinct().count() == 5


def test_no_frame_is_collected(spark, stored):
    r = spark.createDataFrame([(1, "WALK", "bollinger", None, DAYS[0], None)], REQUESTS)
    plan = RQ.evaluate(r, index=stored)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan
    built = RI.range_index(spark.createDataFrame([], BARS))._jdf.queryExecution().executedPlan().toString()
    assert built.count("Exchange hashpartitioning") == 1 and "collect_list" in built and "Window [collect" not in built


def test_gates_ask_the_index_or_the_bars(spark):
    """Both give the same statuses and points."""
    from tickwise.operators import policy as P
    from tickwise.sources import testdata as td
    sf = "/root/testdata/sf0.001"
    bars = td.bars(spark, sf)
    ask = lambda **how: RQ.request_status(td.requests_mixed(spark, sf), td.users(spark, sf), bars, "1999-01-01", P.TEST_POLICY, api_keys=td.api_keys(spark, sf), **how)
    columns = ("request_id", "status_code", "reason", "eff_start", "eff_end", "points")
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (ask(), ask(index=RI.stored_index(bars))))
    assert a == b and len({x[2] for x in a}) >= 6


def test_index_holds_each_bar_once_and_points_come_in_batches(spark, stored):
    """No running sums are stored or shuffled, no lambda computes a point, and equal ranges' requests travel with their range."""
    assert set(stored.columns) == {"symbol", "bar_year", "n", "d", "x"}
    r = spark.createDataFrame([(1, "WALK", "macd", None, DAYS[0], None)], REQUESTS)
    plan = RQ.evaluate(r, index=stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan and "inline(" not in plan


def test_pieces_of_any_size_give_the_same_points(spark, stored, monkeypatch):
    from tickwise.functions import ranges as N
    r = spark.createDataFrame([(i, s, ind, {NAME[ind]: str(3 + i % 40)}, DAYS[i], DAYS[min(1099, 20 + 17 * i % 1100)]) for i, (s, ind) in enumerate([(s, ind) for s in _series() for ind in NAME] * 3)], REQUESTS)
    whole = sorted(map(tuple, RQ.evaluate(r, index=stored).collect()), key=str)
    monkeypatch.setattr(N, "CELLS", 700)
    assert sorted(map(tuple, RQ.evaluate(r, index=stored).collect()), key=str) == whole


def test_nested_points_and_their_documents(spark, stored):
    """One row a request: no point is exploded, joined and grouped again."""
    from tickwise.operators import shaping as SH
    r = spark.createDataFrame([(1, "GAPS", "macd", None, DAYS[0], DAYS[30]), (2, "WALK", "macd", None, DAYS[5], DAYS[8]), (3, "WALK", "macd", None, DAYS[5], DAYS[8]),
                               (3, "WALK", "macd", None, DAYS[5], DAYS[8])], REQUESTS)  # one comes twice
    columns = ["macd", "signal", "histogram"]
    rows, nested = RQ.evaluate(r, index=stored, indicators=["macd"]), RQ.evaluate(r, index=stored, indicators=["macd"], nested=True)
    assert nested.count() == 4
    head = r.select("request_id", "symbol", "indicator", F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0)).alias("parameters"), "start_date", "end_date")
    a, b = (SH.documents(head.join(x, "request_id"), columns).orderBy("request_id") for x in (rows, nested))
    assert a.columns == b.columns and [str(x) for x in a.collect()] == [str(x) for x in b.collect()]


def test_requests_without_a_key_or_user_do_not_land_in_one_task(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        asked = spark.range(4000).select(F.col("id").alias("request_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("api_key"))
        users = spark.createDataFrame([(1, True, "pro")], "id long, is_active boolean, tier string")
        keys = spark.createDataFrame([("key_0000000001", 1, True)], "key string, user_id long, is_active boolean")
        out = RQ.identified(asked, users, keys)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
        assert out.where(F.col("__identity") | F.col("tier").isNotNull() | F.col("user_id").isNotNull()).isEmpty()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
