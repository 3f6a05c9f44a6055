"""Adapters from the driver's tables to the engine's inputs (FIXTURES.md §3).

The driver ships TPC-H-like tables and an event stream, not price bars.
These functions derive ``bars``, ``users``, ``api_keys``, ``requests`` and
``request_log`` from them with plain DataFrame expressions; every rule has a
twin in ``tickwise.plans.oracle`` so DuckDB derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import normalise_dates

# Fixed values of the fixture derivation (FIXTURES.md §3).
INDICATOR_BY_EVENT = {
    "view": "sma",
    "click": "ema",
    "purchase": "rsi",
    "signup": "macd",
    "error": "bollinger",
}
TIER_BY_MOD3 = ("free", "pro", "premium")
REQUEST_EPOCH = "1996-01-01"
REQUEST_SPAN_DAYS = 365
USERS_CREATED_AT = "2024-01-01 00:00:00"
KEY_PREFIX = "key_"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars table of ``sf_dir``, derived from its lineitem table: a lazy
    plan, so building a query runs no job and always sees the current source."""
    return derive_bars(spark, sf_dir)


def derive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (supplier, ship day): floor(extended price) as the price,
    open/close at the smallest/largest (orderkey, linenumber, partkey).

    A plain grouped aggregate: ``min_by``/``max_by``/``min``/``max``/``sum`` are
    all partial aggregates, so a hot supplier is combined map-side before the
    shuffle and never lands whole in one task."""
    li = raw(spark, sf_dir, "lineitem")
    price = F.floor("l_extendedprice").cast("double")
    # The order of (orderkey, linenumber, partkey) as one number: lines are 1 to 7, parts below 10^13.
    # Unlike a struct it can be updated in place, so the aggregate hashes instead of sorting.
    order = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)") * F.lit(10 ** 13).cast("decimal(14,0)") + F.col("l_partkey").cast("decimal(14,0)")
    return (
        li.select("l_suppkey", F.to_date("l_shipdate").alias("date"),
                  price.alias("price"), order.alias("k"), "l_quantity")
        .groupBy("l_suppkey", "date")
        .agg(F.min_by("price", "k").alias("open"),
             F.max("price").alias("high"),
             F.min("price").alias("low"),
             F.max_by("price", "k").alias("close"),
             F.sum("l_quantity").cast("bigint").alias("volume"))
        .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
                "date", "open", "high", "low", "close", "volume")
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar-shaped rows straight from lineitem with a timestamp ``date``
    (input of the date normalisation O2)."""
    li = raw(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("date"),
        F.floor("l_extendedprice").cast("double").alias("close"))


def _tier_of(col: Column) -> Column:
    m = col % 3
    return (F.when(m == 0, F.lit(TIER_BY_MOD3[0]))
            .when(m == 1, F.lit(TIER_BY_MOD3[1]))
            .otherwise(F.lit(TIER_BY_MOD3[2])))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("bigint").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        (F.col("c_custkey") % 10 != 0).alias("is_active"),
        _tier_of(F.col("c_custkey")).alias("tier"),
        F.lit(USERS_CREATED_AT).cast("timestamp").alias("created_at"),
    )


def key_string(id_col: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.lpad(id_col.cast("string"), 10, "0"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("bigint").alias("id"),
        key_string(F.col("o_orderkey")).alias("key"),
        F.col("o_custkey").cast("bigint").alias("user_id"),
        (F.col("o_orderstatus") != "P").alias("is_active"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )


def default_params(indicator: Column) -> Column:
    """The live router's defaults as a string map (values as query strings)."""
    m = F.create_map
    L = F.lit
    return (F.when(indicator.isin("sma", "ema"), m(L("window"), L("20")))
            .when(indicator == "rsi", m(L("period"), L("14")))
            .when(indicator == "macd", m(L("fast_period"), L("12"), L("slow_period"), L("26"),
                                         L("signal_period"), L("9")))
            .when(indicator == "bollinger", m(L("period"), L("20"), L("std_dev"), L("2.0"))))


def _indicator_of(event_type: Column) -> Column:
    expr = None
    for ev, ind in INDICATOR_BY_EVENT.items():
        expr = (F.when(event_type == ev, F.lit(ind)) if expr is None
                else expr.when(event_type == ev, F.lit(ind)))
    return expr


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator requests: one per event (FIXTURES.md §3), spread over all
    symbols and three that have no bars."""
    n = raw(spark, sf_dir, "supplier").agg(F.count(F.lit(1)) + 3).scalar()
    return requests_from_events(raw(spark, sf_dir, "events"), F.concat(F.lit("S"), (F.col("event_id") % n).cast("string")))


def requests_from_events(e: DataFrame, symbol: Column | None = None) -> DataFrame:
    """The request rule as a plain projection, so a stream of events maps
    to a stream of requests with the same code."""
    start = F.date_add(F.lit(REQUEST_EPOCH).cast("date"), (F.col("event_id") % 1000).cast("int"))
    ind = _indicator_of(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"),
        F.lit(None).cast("string").alias("api_key"),
        (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"),
        ind.alias("indicator"),
        default_params(ind).alias("params"),
        start.alias("start_date"),
        F.date_add(start, REQUEST_SPAN_DAYS).alias("end_date"),
    )


def _with_open_ranges(r: DataFrame) -> DataFrame:
    m = F.col("request_id") % 4
    return (r.withColumn("start_date", F.when(m.isin(0, 1), F.lit(None).cast("date"))
                         .otherwise(F.col("start_date")))
             .withColumn("end_date", F.when(m.isin(0, 2), F.lit(None).cast("date"))
                         .otherwise(F.col("end_date"))))


def requests_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every kind: swept parameters (some out of bounds), open
    ranges, an unknown indicator (request_id mod 97 = 0), and API keys in
    place of a session (mod 10 = 0 malformed, mod 10 = 5 the key of order
    ``request_id``)."""
    r = _with_open_ranges(requests_with_params(spark, sf_dir))
    m = F.col("request_id") % 10
    key = F.when(m == 0, F.concat(F.lit("tok_"), F.col("request_id").cast("string"))).when(m == 5, key_string(F.col("request_id")))
    return r.withColumn("api_key", key).withColumn("indicator", F.when(F.col("request_id") % 97 == 0, F.lit("vwap")).otherwise(F.col("indicator")))


def requests_open_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with omitted range ends (input of the default range O36):
    event_id mod 4 = 0 omits both, 1 omits the start, 2 the end."""
    return _with_open_ranges(requests(spark, sf_dir))


def requests_with_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose integer parameter sweeps 0..249 and whose Bollinger
    multiplier sweeps 0.0..6.0 (input of the bounds check O39)."""
    r = requests(spark, sf_dir)
    n = (F.col("request_id") % 250).cast("string")
    k = F.format_number((F.col("request_id") % 61) / 10.0, 1)
    m = F.create_map
    L = F.lit
    params = (F.when(F.col("indicator").isin("sma", "ema"), m(L("window"), n))
              .when(F.col("indicator") == "rsi", m(L("period"), n))
              .when(F.col("indicator") == "macd", m(L("fast_period"), n, L("slow_period"),
                                                    (F.col("request_id") % 230).cast("string"),
                                                    L("signal_period"), L("9")))
              .otherwise(m(L("period"), n, L("std_dev"), k)))
    return r.withColumn("params", params)


def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that present an API key: mod 10 = 0 a malformed token,
    mod 10 = 1 a well-formed key that does not exist, else the key of order
    ``event_id`` (which may be inactive or belong to an inactive user)."""
    e = raw(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    presented = (F.when(m == 0, F.concat(F.lit("tok_"), F.col("event_id").cast("string")))
                 .when(m == 1, key_string(F.col("event_id") + F.lit(1_000_000_000)))
                 .otherwise(key_string(F.col("event_id"))))
    return e.select(F.col("event_id").alias("request_id"), presented.alias("api_key"))


def intake_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk registrations derived from sign-up events."""
    e = raw(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    eid = F.col("event_id")
    padded_user = F.lpad(F.col("user_id").cast("string"), 9, "0")
    username = (F.when(eid % 3 == 0, F.concat(F.lit("Customer#"), padded_user))
                .when(eid % 5 == 0, F.concat(F.lit("u"), (eid % 10).cast("string")))
                .when(eid % 4 == 1, F.concat(F.lit("twin_"), (eid % 90).cast("string")))
                .otherwise(F.concat(F.lit("new_user_"), eid.cast("string"))))
    email = (F.when(eid % 3 == 1, F.concat(F.lit("customer#"), padded_user, F.lit("@example.com")))
             .when(eid % 7 == 0, F.lit("not-an-email"))
             .when(eid % 4 != 3, F.concat(F.lit("twin"), (eid % 70).cast("string"), F.lit("@example.com")))
             .otherwise(F.concat(F.lit("new"), eid.cast("string"), F.lit("@example.com"))))
    tier = F.when(eid % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("pro"))
    return e.select(eid.alias("candidate_id"), username.alias("username"),
                    email.alias("email"), tier.alias("tier"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("event_type").alias("endpoint"),
        F.lit("GET").alias("method"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        F.floor("value").cast("int").alias("response_time"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


__all__ = ["raw", "bars", "raw_bars", "users", "api_keys", "requests", "requests_from_events", "requests_open_ranges", "requests_mixed",
           "requests_with_params", "key_requests", "intake_candidates", "request_log",
           "normalise_dates", "key_string", "default_params"]
