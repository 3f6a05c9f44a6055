"""Streaming quotas: replays, restart from a checkpoint, state that ends."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tickwise.operators import policy as P
from tickwise.sources import testdata as td
from tickwise.streaming import quota_stream as QS


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    count = iter(range(1000))

    def put(*rows):
        """A file of (id, time, user); files are read one a micro-batch, in this order."""
        n = next(count)
        pq.write_table(pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([dt.datetime.fromisoformat(r[1]) for r in rows], pa.timestamp("us")),
                                 "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": pa.array(["view"] * len(rows)), "value": pa.array([1.0] * len(rows)),
                                 "props": pa.array([""] * len(rows))}), str(folder / f"{n}.parquet"))
        os.utime(str(folder / f"{n}.parquet"), (1_000_000 + n, 1_000_000 + n))
    return str(folder), put


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "free"), (2, "premium"), (3, "pro")], "id long, tier string")


def _stream(spark, folder):
    return td.requests_from_events(QS.read_event_stream(spark, folder, files_per_trigger=1))


def test_a_replayed_request_consumes_once(spark, feed, users):
    folder, put = feed
    put((1, "2024-01-01 10:00", 1), (1, "2024-01-01 10:00", 1), (2, "2024-01-01 11:00", 1))
    put((1, "2024-01-01 10:00", 1), (3, "2024-01-01 12:00", 1), (2, "2024-01-01 11:00", 1), (9, "2024-01-01 12:00", 2))
    got = QS.run_to_parquet(spark, QS.decisions_stream(_stream(spark, folder), users, P.TEST_POLICY), "replay").collect()
    assert sorted((r["request_id"], r["allowed"], r["used"]) for r in got) == [(1, True, 0)] * 3 + [(2, True, 1)] * 2 + [(3, False, 2), (9, True, 0)]
    counts = QS.run_counts(spark, QS.daily_counts_stream(_stream(spark, folder), users, P.TEST_POLICY), "replay")
    assert [tuple(r) for r in counts.collect()] == [(1, dt.date(2024, 1, 1), 2)]


def test_restart_from_the_checkpoint(spark, feed, users, tmp_path):
    folder, put = feed
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        query = QS.start(spark, QS.decisions_stream(_stream(spark, folder), users, P.TEST_POLICY), out, ckpt)
        query.processAllAvailable()
        query.stop()
    put((1, "2024-01-01 10:00", 1), (2, "2024-01-01 11:00", 3))
    run()
    put((3, "2024-01-01 12:00", 1), (1, "2024-01-01 10:00", 1))
    put((4, "2024-01-01 13:00", 1))
    run()
    got = sorted((r["request_id"], r["allowed"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, True), (1, True), (2, True), (3, True), (4, False)]


@pytest.mark.parametrize("kind", ["decisions_stream", "daily_counts_stream"])
def test_state_ends_when_the_watermark_passes(spark, feed, users, tmp_path, kind):
    folder, put = feed
    put(*[(i, "2024-01-01 10:00", 1 if i % 2 else 3) for i in range(6)], (50, "2024-01-02 10:00", 1))
    query = QS.start(spark, getattr(QS, kind)(_stream(spark, folder), users, P.TEST_POLICY), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    rows = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.processAllAvailable()
    full = rows()
    put((60, "2024-01-09 10:00", 1))
    query.processAllAvailable()
    put((61, "2024-01-09 11:00", 1), (7, "2024-01-01 09:00", 1))  # the latter after its day's counter has gone: no state
    query.processAllAvailable()
    after = rows()
    query.stop()
    assert 0 < after < full


def test_users_share_a_key_and_unlimited_ones_have_none(spark, feed, tmp_path):
    folder, put = feed
    users = spark.range(64).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'premium' ELSE 'free' END AS tier")
    put(*[(100 * k + u, f"2024-01-01 1{k}:00", u) for u in range(64) for k in range(3)])
    query = QS.start(spark, QS.decisions_stream(_stream(spark, folder), users, P.TEST_POLICY), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.processAllAvailable()
    rows = query.recentProgress[0]["stateOperators"][0]["numRowsTotal"]
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 192 and all(r["allowed"] == (r["user_id"] % 2 == 0 or r["request_id"] < 200) for r in got)
    assert all((r["remaining"] is None) == (r["user_id"] % 2 == 0) for r in got)
    assert rows < 10
