"""Plan shape: pushdown, one exchange for the suite, no Python in batch plans."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from tickwise.functions import kernels as K
from tickwise.operators import indicators as I
from tickwise.operators import series as S
from tickwise.plans.catalog import QUERIES
from tickwise.sources import bars as B
from tickwise.sources import testdata as td


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _bars_path(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.write_bars(td.bars(spark, "/root/testdata/sf0.001"), path)
    return path


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    bars = B.read_bars(spark, _bars_path(spark, tmp_path))
    q = I.sma(S.series(bars, "S1", "1996-01-01", "1996-12-31").select("symbol", "date", "close"), 20)
    plan = _plan(q)
    assert "PushedFilters" in plan and "EqualTo(symbol,S1)" in plan
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "volume" not in read_schema and "open" not in read_schema


def test_year_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "by_year")
    B.write_bars(td.bars(spark, "/root/testdata/sf0.001"), path, by_year=True)
    q = S.in_range(B.read_bars(spark, path), "1996-03-01", "1996-12-31")
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", _plan(q)).group(1)
    assert "bar_year" in filters and ">= 1996" in filters
    assert q.count() == S.in_range(td.bars(spark, "/root/testdata/sf0.001"), "1996-03-01", "1996-12-31").count()


def test_one_long_series_spans_many_tasks(spark):
    """All windows are partitioned by block: no task holds the series."""
    days = spark.range(20_000).select(F.when(F.col("id") >= 0, F.lit("HOT")).otherwise(F.lit("COLD")).alias("symbol"), F.expr("date_add(date'1950-01-01', cast(id as int))").alias("date"), (F.col("id") % 97).cast("double").alias("close"))
    for df in (I.suite(days), I.macd(days)):
        for window in re.findall(r"Window \[[^\n]*", _plan(df)):
            parts = re.findall(r"\], \[([^\]]*)\], \[", window)
            # the numbering is per (series, year), the carry per series over one row a block
            assert parts and ("__blk" in parts[0] or "__cut" in parts[0] or "__n" in window or "__upto" in window), window
    marked = K.in_blocks(days, halo=19)
    assert marked.groupBy("__blk").count().count() == 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert marked.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_python_in_batch_queries(spark):
    for name, q in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = _plan(q(spark, "/root/testdata/sf0.001"))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_quota_ranks_in_two_steps_after_a_shuffle_by_salt(spark):
    """A hot user's requests are cut within salts before they meet."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = _plan(E.queries()["quota_decision"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"hashpartitioning\(user_id#\d+L?, day#\d+, __salt", text)
    assert len(re.findall(r"Window \[row_number", text)) >= 2


def test_rows_of_blocks_move_once(spark):
    """Both reads of the rows, for the ends of their blocks and for themselves, share one exchange, and no null-safe join moves them again."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        days = td.bars(spark, "/root/testdata/sf0.001").select("symbol", "date", "close")
        for df in (I.suite(days), I.macd(days)):
            plan = _plan(df)
            assert len(re.findall(r"\- Exchange hashpartitioning\(__series#\d+L, __blk", plan)) == 1 and "ReusedExchange" in plan
            assert "Exchange hashpartitioning(coalesce(symbol" not in plan
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
