"""Policy, quota, identity, results, sources and streaming units."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tickwise.operators import identity as ID
from tickwise.operators import policy as P
from tickwise.operators import quota as Q
from tickwise.operators import requests as RQ
from tickwise.operators import results as RS
from tickwise.operators import store as ST
from tickwise.plans.catalog import QUERIES
from tickwise.sources import bars as B
from tickwise.sources import testdata as td
from tickwise.streaming import quota_stream as QS

SF = "/root/testdata/sf0.001"


def test_unknown_tier_falls_back_to_free(spark):
    df = spark.createDataFrame([("gold",), (None,), ("pro",)], "tier string")
    out = P.with_limits(df).collect()
    assert [r["requests_per_day"] for r in out] == [50, 50, 500]
    assert out[0]["allowed_indicators"] == ["sma", "ema"]


def test_tier_gate_and_entitlement_agree_for_known_tiers(spark):
    rows = [(t, i) for t in ("free", "pro", "premium") for i in ("sma", "EMA", "rsi", "macd", "bollinger")]
    df = spark.createDataFrame(rows, "tier string, indicator string")
    out = df.select(P.tier_gate(F.col("tier"), F.col("indicator")).alias("g"),
                    P.indicator_allowed(F.col("tier"), F.col("indicator")).alias("e")).collect()
    assert all(r["g"] == r["e"] for r in out)


def test_params_bounds(spark):
    rows = [("sma", {"window": "200"}), ("sma", {"window": "201"}), ("bollinger", {"std_dev": "0.05"}),
            ("macd", {"slow_period": "x"}), ("rsi", {}), ("rsi", {"unknown": "5"})]
    df = spark.createDataFrame(rows, "indicator string, params map<string,string>")
    got = [r[0] for r in df.select(P.params_within_bounds(F.col("indicator"), F.col("params"))).collect()]
    assert got == [True, False, False, False, True, True]


def test_clamp_can_leave_an_empty_range(spark):
    df = spark.createDataFrame([(dt.date(1990, 1, 1), dt.date(1990, 2, 1), 90)],
                               "s date, e date, lim int")
    s, e = P.clamp_range(F.col("s"), F.col("e"), F.col("lim"), "1999-01-01",
                         F.lit(dt.date(1995, 1, 2)), F.lit(dt.date(2001, 11, 4)))
    r = df.select(s.alias("s"), e.alias("e")).first()
    assert r["s"] == dt.date(1998, 10, 3) and r["e"] == dt.date(1990, 2, 1)


def test_quota_rejected_requests_do_not_consume(spark):
    ts = [dt.datetime(2024, 1, 1, 9, m) for m in range(5)] + [dt.datetime(2024, 1, 2, 9, 0)]
    rows = [(i, t, 1, 2) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, user_id long, daily_limit int")
    out = Q.quota_decision(df).orderBy("request_id").collect()
    assert [r["allowed"] for r in out] == [True, True, False, False, False, True]
    assert [r["used"] for r in out] == [0, 1, 2, 2, 2, 0]
    assert out[2]["reset_date"] == dt.date(2024, 1, 2)


def test_glob_to_regex():
    import re
    rx = re.compile(RS.glob_to_regex("indicator:S1:*"))
    assert rx.match("indicator:S1:SMA:x") and not rx.match("indicator:S10:SMA:x")
    assert re.match(RS.glob_to_regex("a?c[xy]\\*"), "abcx*")


def test_materialise_fresh_and_invalidate(spark, tmp_path):
    path = str(tmp_path / "results")
    res = spark.createDataFrame([("S1", "sma", "k1", dt.date(2000, 1, 1), 1.0),
                                 ("S2", "ema", "k2", dt.date(2000, 1, 1), 2.0)],
                                "symbol string, indicator string, params_key string, date date, value double")
    RS.materialise(res, path, "2024-01-01 10:00:00")
    RS.materialise(res.where("symbol = 'S1'"), path, "2024-01-01 10:20:00")
    cache = spark.read.parquet(path)
    fresh = RS.fresh(cache, "2024-01-01 10:35:00")  # 30 min TTL: only the second write
    assert fresh.count() == 1
    newest = RS.newest_per_key(cache, ["value"]).orderBy("params_key").collect()
    assert [r["params_key"] for r in newest] == ["k1", "k2"]
    assert RS.invalidate(cache, "k1*").select("params_key").distinct().collect()[0][0] == "k2"


def test_sink_roundtrip_and_source_guard(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = td.bars(spark, SF)
    B.write_bars(bars, path)
    back = B.read_bars(spark, path)
    assert back.count() == bars.count()
    assert dict(back.dtypes)["date"] == "date"
    with pytest.raises(Exception):
        B.read_bars(spark, str(tmp_path / "missing"))


def test_limits_are_the_rows_own(spark):
    """A limit above every policy's, limits of 0, and no limited row at all."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 1, 1000) for i in range(1100)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, user_id long, daily_limit int")
    assert Q.quota_decision(df).where("allowed").count() == 1000
    assert Q.quota_decision(df.withColumn("daily_limit", F.lit(0))).where("allowed").count() == 0
    assert Q.quota_decision(df.withColumn("daily_limit", F.lit(None).cast("int"))).where("allowed").count() == 1100


def _bars(spark, rows):
    return spark.createDataFrame([(s, d, float(c)) for s, d, c in rows], "symbol string, date date, close double")


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, symbol string, indicator string, params map<string,string>, start_date date, end_date date")


def test_evaluate_uses_each_requests_parameters_and_open_ranges(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(1300)]
    closes = [100 + (i * 37) % 50 for i in range(1300)]
    bars = _bars(spark, [("A", d, c) for d, c in zip(days, closes)])
    r = _requests(spark, [(1, "A", "SMA", {"window": "5"}, days[10], days[60]), (2, "A", "sma", None, days[10], None), (3, "A", "ema", {"window": "3"}, None, None),
                          (4, "A", "ema", {"window": "1"}, None, days[5]), (5, "A", "macd", {"fast_period": "3"}, days[0], None), (6, "A", "bollinger", {"std_dev": "1.5"}, days[3], days[40]),
                          (7, "A", "rsi", {"period": "2"}, days[3], days[40]), (8, "A", "vwap", None, None, None), (9, "B", "sma", None, None, None), (10, "A", "SMA", {"window": "5"}, days[10], days[60])])
    got = {}
    for row in RQ.evaluate(r, bars).orderBy("date").collect():
        got.setdefault(row["request_id"], []).append(row)
    import pandas as pd
    c = pd.Series(closes, dtype=float)
    near = lambda rows, col, want: all((x[col] is None and pd.isna(w)) or abs(x[col] - w) < 1e-9 for x, w in zip(rows, want, strict=True))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 10} and [x["value"] for x in got[1]] == [x["value"] for x in got[10]]
    assert near(got[1], "value", c[10:61].rolling(5, min_periods=1).mean()) and near(got[2], "value", c[10:].rolling(20, min_periods=1).mean())
    assert near(got[3], "value", c.ewm(span=3, adjust=False).mean()) and near(got[4], "value", c[:6])
    line = c.ewm(span=3, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert near(got[5], "macd", line) and near(got[5], "signal", line.ewm(span=9, adjust=False).mean())
    part = c[3:41]
    assert near(got[6], "upper", part.rolling(20, min_periods=1).mean() + 1.5 * part.rolling(20, min_periods=1).std())
    d = part.diff().fillna(0)
    up, down = d.clip(lower=0).rolling(2, min_periods=1).sum(), (-d).clip(lower=0).rolling(2, min_periods=1).sum()
    assert near(got[7], "value", [float("nan") if u == v == 0 else 100.0 if v == 0 else 100 - 100 / (1 + u / v) for u, v in zip(up, down)])


def test_every_reason_occurs(spark):
    got = {r["reason"] for r in QUERIES["batch_request_status"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert got == {"unknown_indicator", "unauthenticated", "tier", "bounds", "quota", "unknown_symbol", "empty_range", "ok"}


def test_intake_settles_conflicts_in_order(spark):
    users = spark.createDataFrame([("old", "old@x.yz")], "username string, email string")
    rows = [(1, "abc", "a@x.yz", None), (2, "abc", "b@x.yz", None), (3, "bcd", "b@x.yz", "pro"), (4, "cde", "b@x.yz", None), (5, "old", "n@x.yz", None), (6, "new", "n@x.yz", None),
            (7, "x", "q@x.yz", None), (8, "xyz", "no-email", None), (9, "xyz", "q@x.yz", None), (10, None, "r@x.yz", None)]
    c = spark.createDataFrame(rows, "candidate_id long, username string, email string, tier string")
    got = {r["candidate_id"]: r["status"] for r in ID.intake_check(c, users).collect()}
    assert got == {1: "ok", 2: "conflict", 3: "ok", 4: "conflict", 5: "conflict", 6: "ok", 7: "invalid_username", 8: "invalid_email", 9: "ok", 10: "invalid_username"}


def test_read_through_and_delete(spark, tmp_path):
    path = str(tmp_path / "results")
    res = spark.createDataFrame([("sma", "k1", 1.0), ("sma", "k2", 2.0), ("ema", "j1", 3.0), ("rsi", "k9", 4.0)], "indicator string, params_key string, value double")
    RS.materialise(res, path, "2024-01-01 10:00:00")
    asked = spark.createDataFrame([("k1",), ("k1",), ("zz",)], "params_key string")
    out = {r["params_key"]: (r["hit"], r["value"]) for r in RS.read_through(asked, spark.read.parquet(path), lambda m: m.withColumn("value", F.lit(7.0)), "2024-01-01 10:10:00").collect()}
    assert out == {"k1": (True, 1.0), "zz": (False, 7.0)}
    kept = str(tmp_path / "store")
    ST.append(res, kept, "2024-01-01 10:00:00")
    assert ST.invalidate(spark, kept, "k[12]") == 2 and ST.invalidate(spark, kept, "nothing*") == 0
    assert sorted(r[0] for r in ST.read(spark, kept).select("params_key").collect()) == ["j1", "k9"]
    tied = res.withColumn("cached_at", F.lit("2024-01-01").cast("timestamp")).withColumn("params_key", F.lit("k"))
    assert RS.newest_per_key(tied, ["value"]).first()["value"] == 4.0


@pytest.mark.parametrize("pattern,yes,no", [("a[&&b]c", "a&c", "adc"), ("a[]c", "a[]c", "ac"), ("x[^y]", "xz", "xy"), ("p[[]q", "p[q", "pq"), ("a.b*", "a.bc", "axbc")])
def test_globs_mean_the_same_in_java(spark, pattern, yes, no):
    df = spark.createDataFrame([(yes,), (no,), (None,)], "params_key string")
    assert [r[0] for r in RS.matching(df, pattern).collect()] == [yes]
    assert RS.invalidate(df, pattern).count() == 2


def test_late_events_and_open_days_are_counted(spark, tmp_path):
    """A late event of a closed day gets a decision and is counted; so is the last day."""
    users = spark.createDataFrame([(1, "free"), (2, "premium")], "id long, tier string")
    flat = tmp_path / "events"
    flat.mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq
    batches = [[(1, "2024-01-01 10:00", 1), (2, "2024-01-01 11:00", 2)], [(3, "2024-01-09 10:00", 1)], [(4, "2024-01-01 09:00", 1), (5, "2024-01-09 11:00", 1), (6, "2024-01-09 12:00", 1)]]
    for n, rows in enumerate(batches):
        pq.write_table(pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([dt.datetime.fromisoformat(r[1]) for r in rows], pa.timestamp("us")),
                                 "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": pa.array(["view"] * len(rows)), "value": pa.array([1.0] * len(rows)),
                                 "props": pa.array([""] * len(rows))}), str(flat / f"{n}.parquet"))
        os.utime(str(flat / f"{n}.parquet"), (1_000_000 + n, 1_000_000 + n))
    stream = lambda: td.requests_from_events(QS.read_event_stream(spark, str(flat), files_per_trigger=1))
    got = {r["request_id"]: r["allowed"] for r in QS.run_to_parquet(spark, QS.decisions_stream(stream(), users, P.TEST_POLICY), "late").collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}
    counts = {(r["user_id"], str(r["day"])): r["requests"] for r in QS.run_counts(spark, QS.daily_counts_stream(stream(), users, P.TEST_POLICY), "late").collect()}
    assert counts == {(1, "2024-01-01"): 2, (1, "2024-01-09"): 2}


def test_stream_decisions_equal_batch_over_micro_batches(spark, tmp_path):
    """Three time-ordered files, one per micro-batch: state carries the counts."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "events")
    cuts = ["2024-01-10", "2024-01-20"]
    parts = [events.where(F.col("ts") < cuts[0]),
             events.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])),
             events.where(F.col("ts") >= cuts[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    # flatten into one folder so the file source sees three files
    flat = str(tmp_path / "flat")
    os.makedirs(flat)
    for i in range(3):
        d = os.path.join(src, f"part{i}")
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"{i}.parquet"))
    users = td.users(spark, SF)
    stream = QS.read_event_stream(spark, flat, files_per_trigger=1)
    got = QS.run_to_parquet(spark, QS.decisions_stream(td.requests_from_events(stream), users,
                                                       P.TEST_POLICY), "t-stream")
    batch = Q.quota_decision(Q.with_daily_limit(td.requests(spark, SF), users, P.TEST_POLICY))
    cols = ["request_id", "allowed", "used", "remaining"]
    a = sorted(tuple(r) for r in got.select(cols).collect())
    b = sorted(tuple(r) for r in batch.select(cols).collect())
    assert a == b
