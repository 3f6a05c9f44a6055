"""Stored results in versions: interrupted, concurrent, compacted; key lookup."""

import pytest
from pyspark.sql import functions as F

from tickwise.operators import store as ST


def _rows(spark, keys, indicator="sma"):
    return spark.createDataFrame([(indicator, k, float(i)) for i, k in enumerate(keys)], "indicator string, params_key string, value double")


def _keys(spark, path, at=None):
    return sorted(str(r[0]) for r in ST.read(spark, path, at).select("params_key").collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


class Stop(Exception):
    pass


def test_steps_that_stop_leave_a_whole_version(spark, path, monkeypatch):
    ST.append(_rows(spark, ["a1", "a2", "b1"]), path, "2024-01-01")

    def stopped(*a, **k):
        raise Stop
    with monkeypatch.context() as m:
        m.setattr(ST, "_commit", stopped)  # after the data, before the log
        for step in (lambda: ST.append(_rows(spark, ["c1"]), path, "2024-01-02"), lambda: ST.invalidate(spark, path, "a*"), lambda: ST.compact(spark, path)):
            with pytest.raises(Stop):
                step()
            assert _keys(spark, path) == ["a1", "a2", "b1"]
    with monkeypatch.context() as m:
        m.setattr(ST, "_write", lambda rows, p, name: rows.limit(1).write.parquet(f"{p}/data/{name}") or stopped())  # in the middle of the data
        with pytest.raises(Stop):
            ST.append(_rows(spark, ["c1", "c2"]), path, "2024-01-02")
    assert _keys(spark, path) == ["a1", "a2", "b1"]
    assert ST.invalidate(spark, path, "a*") == 2 and _keys(spark, path) == ["b1"]


def test_a_reader_keeps_its_version(spark, path):
    ST.append(_rows(spark, ["a1", "b1"]), path, "2024-01-01")
    old = ST.version(spark, path)
    ST.append(_rows(spark, ["a2"], "ema"), path, "2024-01-02")
    ST.invalidate(spark, path, "?1")
    ST.compact(spark, path)
    assert _keys(spark, path, old) == ["a1", "b1"] and _keys(spark, path) == ["a2"]


def test_writers_side_by_side(spark, path):
    """Each works on the version that it took; none undoes another."""
    ST.append(_rows(spark, ["a1", "b1"]), path, "2024-01-01")
    seen = ST.version(spark, path)
    ST.append(_rows(spark, ["a2", "b2"]), path, "2024-01-02")  # while the others run
    assert ST.invalidate(spark, path, "a*", at=seen) == 1
    assert _keys(spark, path) == ["a2", "b1", "b2"]
    both = ST.version(spark, path)
    ST.compact(spark, path, at=seen)  # doesn't know of the deletion
    assert _keys(spark, path) == ["a2", "b1", "b2"]
    ST.compact(spark, path, at=both)  # its folders have been replaced in part: ignored
    assert _keys(spark, path) == ["a2", "b1", "b2"]
    ST.compact(spark, path)
    now = ST.version(spark, path)
    assert len(now.folders) == 1 and ST._left(now, now.folders[0]) == () and _keys(spark, path) == ["a2", "b1", "b2"]
    assert ST.invalidate(spark, path, "b*") == 2 and _keys(spark, path) == ["a2"]


def test_null_keys_and_indicators_and_new_columns(spark, path):
    ST.append(spark.createDataFrame([(None, "a1", 1.0), ("sma", None, 2.0)], "indicator string, params_key string, value double"), path, "2024-01-01")
    ST.append(_rows(spark, ["a2"]).withColumn("note", F.lit("new")), path, "2024-01-01")
    assert ST.invalidate(spark, path, "a1") == 1
    assert _keys(spark, path) == ["None", "a2"]
    ST.compact(spark, path)
    assert {r["note"] for r in ST.read(spark, path).collect()} == {None, "new"}


def test_an_empty_store(spark, path):
    ST.append(_rows(spark, []) if False else _rows(spark, ["x"]).limit(0), path, "2024-01-01")
    assert _keys(spark, path) == [] and ST.invalidate(spark, path, "*") == 0


def _scanned(df):
    """Rows that the scans of an executed plan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_a_probe_skips_row_groups(spark, path):
    n = 40_000
    rows = spark.range(n).select(F.lit("sma").alias("indicator"), F.concat(F.lit("indicator:S"), F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0"), F.lit(":SMA")).alias("params_key"),
                                 F.rand(1).alias("value"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "parquet.block.size")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's scans are the ones that ran
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        ST.append(rows, path, "2024-01-01")
        one = ST.probe(spark, path, ["indicator:S001234:SMA"])
        assert one.count() == 1 and _scanned(one) < n / 10
        glob = ST.read(spark, path).where(ST.key_matches("indicator:S0012??:*", ST.KEY))
        assert glob.count() == 100 and _scanned(glob) < n / 10
        assert "StringStartsWith(params_key,indicator:S0012)" in glob._jdf.queryExecution().executedPlan().toString()
        absent = ST.probe(spark, path, ["indicator:S001234x:SMA"])  # between the bounds of a row group: only its bloom filter tells
        assert absent.count() == 0 and _scanned(absent) == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
