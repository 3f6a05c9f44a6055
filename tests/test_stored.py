"""Stored blocks and appended bars: equal to the suite over the whole history."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwise.operators import incremental as INC
from tickwise.operators import indicators as I
from tickwise.operators import series as S
from tickwise.sources import read_bars, read_blocks, testdata, write_bars, write_blocks
from tickwise.sources.bars import _table

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    write_bars(testdata.bars(spark, SF), path, by_year=True)
    return read_bars(spark, path).select("symbol", "date", "close")


@pytest.fixture(scope="module")
def blocks(spark, bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    write_blocks(bars, path, halo=30, buckets=6)
    spark.sql(f"DROP TABLE {_table(path)}")  # as another session finds it
    return read_blocks(spark, path)


def _same(a, b):
    a, b = (x.orderBy("symbol", "date").toPandas() for x in (a, b))
    pd.testing.assert_frame_equal(a[sorted(b.columns)], b[sorted(b.columns)], rtol=1e-12)


@pytest.mark.parametrize("name,exchanges", [("sma", 0), ("rsi", 0), ("bollinger", 0), ("ema", 2)])
def test_windows_read_stored_blocks_without_an_exchange(spark, bars, blocks, name, exchanges):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = getattr(I, name)(blocks)
        assert _plan(out).count("Exchange") <= exchanges  # the mean's: block ends, one row each
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    _same(out, getattr(I, name)(bars))


def test_suite_on_stored_blocks(bars, blocks):
    _same(I.suite(blocks), I.suite(bars))


def test_blocks_tell_when_their_halo_is_too_short(blocks):
    I.sma(blocks, 31)
    with pytest.raises(ValueError, match="31 are needed"):
        I.sma(blocks, 32)


def _appended(spark, bars, days, tmp_path):
    """The suite in steps: up to the first day, then from day to day."""
    first = bars.where(F.col("date") < days[0])
    state, out = INC.suite_state(first), []
    for n, (a, b) in enumerate(zip(days, [*days[1:], None])):
        state.write.parquet(str(tmp_path / f"state{n}"))
        state = spark.read.schema(INC.STATE_SCHEMA).parquet(str(tmp_path / f"state{n}"))
        points, state = INC.append_suite(S.in_range(bars, a, b - dt.timedelta(days=1) if b else None), state, path=str(tmp_path / f"points{n}") if n % 2 else None)
        out.append(points.toPandas())
    return pd.concat(out), state


def test_appended_bars_equal_the_whole_run(spark, bars, tmp_path):
    days = [dt.date(1997, 3, 1), dt.date(1997, 3, 4), dt.date(1997, 3, 5), dt.date(1997, 9, 1)]
    odd = spark.createDataFrame([("NEW", dt.date(1997, 3, 4) + dt.timedelta(days=i), None if i % 4 == 1 else float(i * 7 % 13)) for i in range(300)]
                                + [("GAP", dt.date(1996, 1, 1), 5.0), ("GAP", dt.date(1999, 1, 1), 7.0), ("OLD", dt.date(1996, 1, 1), 3.0), ("VOID", dt.date(1996, 1, 1), None),
                                   ("VOID", dt.date(1998, 1, 1), 2.0)], "symbol string, date date, close double")
    every = bars.unionByName(odd)
    got, state = _appended(spark, every, days, tmp_path)
    whole = I.suite(every)
    want = whole.where(F.col("date") >= days[0]).toPandas()
    by = ["symbol", "date"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True)[want.columns], want.sort_values(by, ignore_index=True), rtol=1e-9, atol=1e-9)
    ends = {r["symbol"]: r for r in state.collect()}
    assert len(ends) == every.select("symbol").distinct().count() and ends["OLD"]["ema"] == 3.0 and len(ends["OLD"]["tail"]) == 1
    assert max(len(r["tail"]) for r in ends.values()) == INC.tail_rows()


def test_late_bars_are_listed_and_left_out(spark):
    day = dt.date(2001, 1, 1)
    made = lambda rows: spark.createDataFrame(rows, "symbol string, date date, close double")
    state = INC.suite_state(made([("A", day, 1.0), ("A", day + dt.timedelta(days=1), 2.0)]))
    new = made([("A", day, 9.0), ("A", day + dt.timedelta(days=2), 3.0), ("B", day, 4.0)])
    assert [tuple(r) for r in INC.late_bars(new, state).collect()] == [("A", day, 9.0)]
    points, after = INC.append_suite(new, state)
    assert {(r["symbol"], r["sma"]) for r in points.collect()} == {("A", 2.0), ("B", 4.0)}
    assert {(r["symbol"], len(r["tail"])) for r in after.collect()} == {("A", 3), ("B", 1)}


def test_a_new_day_reads_only_its_years(spark, tmp_path):
    write_bars(testdata.bars(spark, SF), str(tmp_path / "b"), by_year=True)
    bars = read_bars(spark, str(tmp_path / "b"))
    INC.suite_state(bars.where(F.col("date") < "2001-01-01")).write.parquet(str(tmp_path / "s"))
    state = spark.read.schema(INC.STATE_SCHEMA).parquet(str(tmp_path / "s"))
    points, _ = INC.append_suite(S.in_range(bars, "2001-01-01", None), state)
    scans = [line for line in _plan(points).splitlines() if "FileScan" in line and "bar_year" in line]
    assert scans and all("bar_year" in line.split("PartitionFilters")[1].split("]")[0] and ">= 2001" in line for line in scans)
