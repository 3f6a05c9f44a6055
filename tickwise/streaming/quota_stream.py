"""Quota accounting on a stream of requests.

One state processor (``transformWithState``) decides every event of a limited
user; unlimited tiers have no state and are decided without it. Its key is (group
of users, UTC day), where a group is ``USERS`` consecutive user ids at most: a key
costs several round trips to the state store, which a few users share. Its state
holds, for each user, the list of request ids that have consumed the day's quota,
at most the daily limit; a request that comes again is known by its id, gets its
decision again and consumes nothing. An event-time timer drops the state once the
day and the allowed lateness are over, so the store holds only open days of
limited users. Every event gets a decision: one that comes later than that finds
a counter that starts anew, as it would in the service, whose counters expire
too, and leaves no state.

A key's events of one micro-batch come in chunks, each sorted by (ts,
request_id). Decisions follow arrival: they equal the batch decision (O40) when
events arrive in time order.

O44 writes what each micro-batch consumed per (user, day): increments, so the
open day is reported as well and late events are counted without state for
days that are over. ``latest_counts`` sums them up to the daily limit.

Both write to a parquet sink under the shared checkpoint folder; nothing is
collected on the driver. A query that is started again on its checkpoint goes
on where it was. The state store is RocksDB, which ``transformWithState`` needs.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.policy import DEFAULT_POLICY, tier_limits
from ..operators.quota import day_of
from ..session import scratch_path

# The state function runs in executor Python workers; ship it by value so the
# workers need only pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

DECISION_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("day", T.DateType()),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("used", T.IntegerType()),
    T.StructField("remaining", T.IntegerType()),
    T.StructField("reset_date", T.DateType()),
])

COUNT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("day", T.DateType()),
    T.StructField("daily_limit", T.LongType()),
    T.StructField("requests", T.LongType()),
])

STATE_SCHEMA = T.StructType([T.StructField("users", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.IntegerType())),
                             T.StructField("consumed", T.ArrayType(T.LongType()))])  # users, how many ids each holds, all ids

USERS = 64  # user ids of a key, at most

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_event_stream(spark: SparkSession, folder: str, glob: str | None = None,
                      files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


class QuotaProcessor(StatefulProcessor):
    """Decisions of one (group of users, day), or with ``counts`` what they consume."""

    def __init__(self, counts: bool = False):
        self.counts = counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("consumed", STATE_SCHEMA)

    def _held(self) -> dict[int, dict]:
        """user -> request id -> consumed before that many others"""
        value = self.state.get()
        if value is None:
            return {}
        ends = np.cumsum([0, *value[1]])
        ids = list(value[2])
        return {u: {r: n for n, r in enumerate(ids[a:b])} for u, a, b in zip(value[0], ends[:-1], ends[1:])}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, last = key[1], 0
        places = self._held()
        before = {u: len(place) for u, place in places.items()}
        limits: dict[int, int] = {}
        for pdf in rows:
            if pdf.empty:
                continue
            pdf = pdf.sort_values(["ts", "request_id"], kind="stable")
            last = max(last, int(pdf["expires_ms"].iloc[0]))
            users, ids, caps = pdf["user_id"].tolist(), pdf["request_id"].tolist(), pdf["daily_limit"].tolist()
            for u, r, limit in zip(users, ids, caps):
                place = places.setdefault(u, {})
                limits[u] = int(limit)
                if len(place) < limit:
                    place.setdefault(r, len(place))
            if not self.counts:
                yield self._decided(ids, users, day, caps, places)
        more = {u: len(place) - before.get(u, 0) for u, place in places.items() if len(place) > before.get(u, 0)}
        if self.counts and more:
            yield pd.DataFrame({"user_id": list(more), "day": [day] * len(more), "daily_limit": [limits[u] for u in more], "requests": list(more.values())})
        # Nothing is kept beyond the lateness: its timer would be over already.
        if more and last > timerValues.getCurrentWatermarkInMs():
            kept = {u: list(place) for u, place in places.items() if place}
            self.state.update((list(kept), [len(ids) for ids in kept.values()], [r for ids in kept.values() for r in ids]))
            self.handle.registerTimer(last)

    @staticmethod
    def _decided(ids: list, users: list, day, caps: list, places: dict) -> pd.DataFrame:
        n, limit = len(ids), np.array(caps, np.int64)
        used = np.array([places[u].get(r, c) for u, r, c in zip(users, ids, caps)], np.int64)
        allowed = np.array([r in places[u] for u, r in zip(users, ids)], bool)
        reset = np.where(allowed, None, day + dt.timedelta(days=1))
        return pd.DataFrame({"request_id": ids, "user_id": users, "day": [day] * n, "allowed": allowed, "used": used, "remaining": limit - used, "reset_date": reset})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _processed(requests: DataFrame, users: DataFrame, policy, lateness: str, counts: bool) -> DataFrame:
    u = users.select(F.col("id").alias("user_id"), "tier")
    r = (requests.withWatermark("ts", lateness).join(u, "user_id", "left")
                 .withColumn("daily_limit", tier_limits(F.col("tier"), policy)["requests_per_day"])
                 .withColumn("day", day_of(F.col("ts")))
                 .withColumn("expires_ms", F.unix_millis(F.date_add("day", 1).cast("timestamp")))
                 .select("request_id", "user_id", "day", "ts", "daily_limit", "expires_ms"))
    limited = F.col("daily_limit") > 0 if counts else F.col("daily_limit").isNotNull()
    out = (r.where(limited).withColumn("users", F.floor(F.col("user_id") / F.lit(USERS))).groupBy("users", "day")
           .transformWithStateInPandas(QuotaProcessor(counts), COUNT_SCHEMA if counts else DECISION_SCHEMA, "Append", "EventTime"))
    if counts:
        return out
    free = r.where(F.col("daily_limit").isNull()).select("request_id", "user_id", "day", F.lit(True).alias("allowed"), F.lit(0).alias("used"),
                                                         F.lit(None).cast("int").alias("remaining"), F.lit(None).cast("date").alias("reset_date"))
    return out.unionByName(free)


def decisions_stream(requests: DataFrame, users: DataFrame, policy=DEFAULT_POLICY, lateness: str = "1 day") -> DataFrame:
    """Per-event allow/deny; ``users`` is a static table (stream-static
    join on its unique id). ``lateness``: how long after its end a day's counter is kept."""
    return _processed(requests, users, policy, lateness, counts=False)


def daily_counts_stream(requests: DataFrame, users: DataFrame, policy=DEFAULT_POLICY, lateness: str = "1 day") -> DataFrame:
    """Requests of limited users that each micro-batch consumed, per (user, UTC day)."""
    return _processed(requests, users, policy, lateness, counts=True)


def start(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str):
    """Start a stream into a parquet folder; call it again with the same
    folders to go on."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_to_parquet(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming query until its source is drained, into a parquet
    sink under the shared checkpoint folder; return the sink as a batch
    DataFrame."""
    out = scratch_path(spark, f"{name}-out")
    query = start(spark, stream, out, scratch_path(spark, f"{name}-ckpt"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def run_counts(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return latest_counts(run_to_parquet(spark, stream, name))


def latest_counts(counts: DataFrame) -> DataFrame:
    """Consumed requests per (user, day): the increments, up to the limit (a
    counter that started anew doesn't know of those before)."""
    total = F.least(F.sum("requests"), F.max("daily_limit"))
    return counts.groupBy("user_id", "day").agg(total.alias("requests"))
