"""Mergeable log rollups, statistics from footers, profiles, keys and cache counts."""

import datetime as dt

from pyspark.sql import functions as F

from tickwise.operators import identity as ID
from tickwise.operators import logs as LG
from tickwise.operators import quota as Q
from tickwise.operators import results as RS
from tickwise.operators import series as S
from tickwise.sources import testdata as td
from tickwise.sources import write_bars

SF = "/root/testdata/sf0.001"


def test_merged_days_equal_the_log_within_the_rank_error(spark):
    n, k = 60_000, 400
    ms = F.pmod(F.xxhash64("id"), F.lit(5000))
    log = spark.range(n).select(F.lit("e").alias("endpoint"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 28))").alias("timestamp"),
                                F.lit(200).alias("status_code"), ms.cast("int").alias("response_time"))
    days = LG.daily_sketches(log, k=k)
    assert days.count() == 28
    merged = LG.merged_rollup(days, F.trunc("day", "month"), ranks=(0.1, 0.5, 0.9, 0.99), k=k).first()
    assert merged["requests"] == n
    values = sorted(r[0] for r in log.select("response_time").collect())
    assert abs(merged["avg_ms"] - sum(values) / n) < 1e-9
    for rank in (0.1, 0.5, 0.9, 0.99):
        got = merged[f"p{round(100 * rank)}_ms"]
        assert abs(sum(v <= got for v in values) / n - rank) < 0.02  # k = 400 states about 0.7 %
    assert max(len(r[0]) for r in days.select("sketch").collect()) < 20_000


def test_rollup_of_untimed_requests(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 5), 500, None), ("a", dt.datetime(2024, 1, 2, 5), None, None), ("b", dt.datetime(2024, 1, 1, 5), 200, 7), ("b", dt.datetime(2024, 1, 7, 5), 200, None),
            ("b", dt.datetime(2024, 1, 8, 5), 503, 9)]
    log = spark.createDataFrame(rows, "endpoint string, timestamp timestamp, status_code int, response_time int")
    got = {(r["endpoint"], str(r["period"])): tuple(r)[2:] for r in LG.merged_rollup(LG.daily_sketches(log)).collect()}
    assert got == {("a", "2024-01-01"): (2, None, None, None, 0.5), ("b", "2024-01-01"): (2, 7.0, 7.0, 7.0, 0.0), ("b", "2024-01-08"): (1, 9.0, 9.0, 9.0, 1.0)}
    assert LG.merged_rollup(LG.daily_sketches(log.limit(0))).collect() == []


def test_range_of_a_stored_table_comes_from_footers(spark, tmp_path):
    bars = td.bars(spark, SF)
    write_bars(bars, str(tmp_path / "b"))
    out = S.stored_range(spark, str(tmp_path / "b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan and "BatchScan" in plan
    want = bars.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert tuple(out.first()) == tuple(want)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


def test_profile_in_one_pass_and_on_the_way_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None, {"k": 1}), (None, "a", 2.5, None)], "n long, s string, x double, m map<string,int>")
    rows = [tuple(r) for r in S.dataset_profile(df).orderBy("position").collect()]
    assert rows == [(1, "n", "bigint", 2, 1, "1", "1"), (2, "s", "string", 2, 0, "a", "b"), (3, "x", "double", 2, 1, "2.5", "2.5"), (4, "m", "map<string,int>", 2, 1, None, None)]
    seen_df, seen = S.observed(df)
    seen_df.write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in S.profile_of(df, seen).orderBy("position").collect()] == rows
    empty = [tuple(r) for r in S.dataset_profile(df.limit(0)).orderBy("position").collect()]
    assert [r[3:] for r in empty] == [(0, 0, None, None)] * 4
    assert S.dataset_profile(df)._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition") == 1


def test_keys_are_deactivated_by_their_owner_only(spark):
    keys = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 11, True), (4, None, True)], "id long, user_id long, is_active boolean")
    asked = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (10, 3), (12, 1), (None, 4), (10, None)], "user_id long, key_id long")
    after, told = ID.deactivate_keys(keys, asked)
    assert {(r["id"], r["is_active"]) for r in after.collect()} == {(1, False), (2, False), (3, True), (4, True)} and after.columns == keys.columns
    got = sorted((str(r["user_id"]), str(r["key_id"]), r["status_code"]) for r in told.collect())
    assert got == sorted([("10", "1", 200), ("10", "1", 200), ("10", "2", 200), ("10", "3", 404), ("12", "1", 404), ("None", "4", 404), ("10", "None", 404)])


def test_hits_and_misses_by_indicator(spark):
    entries = spark.createDataFrame([("indicator:A:SMA:w", "2024-01-01 10:00:00"), ("indicator:A:SMA:w", "2024-01-01 10:01:00"), ("indicator:A:RSI:p", "2024-01-01 08:00:00")],
                                    "params_key string, at string").withColumn("cached_at", F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([("indicator:A:SMA:w",)] * 3 + [("indicator:B:SMA:w",), ("indicator:A:RSI:p",)], "params_key string")
    got = {tuple(r) for r in RS.hit_counts(asked, entries, "2024-01-01 10:10:00").collect()}
    assert got == {("sma", 4, 3, 1), ("rsi", 1, 0, 1)}


def test_unlimited_tiers_are_told_what_the_counters_say(spark):
    r = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1), None), (2, 6, dt.datetime(2024, 1, 1), 3)], "request_id long, user_id long, ts timestamp, daily_limit int")
    got = {x["request_id"]: x["remaining"] for x in Q.quota_decision(r, unlimited_remaining=Q.SHARED_UNLIMITED).collect()}
    assert got == {1: 999999, 2: 3}
