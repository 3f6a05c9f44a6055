"""Registered queries: one per operator of SURVEY §2.

Every entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables (or
tables Spark derives from them), so its work grows with the data. The
DuckDB twin of each entry lives in ``tickwise.plans.oracle`` under the same
name; column names and types agree, and float columns that are not bit-exact
between the engines are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import indicators as I
from ..operators import series as S
from ..session import scratch_path
from ..sources import bars as B
from ..sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def r4(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# --- scans, filters, statistics (O1-O17) ------------------------------------------

@query("bars_scan")
def bars_scan(spark, sf):
    return td.bars(spark, sf)


@query("bars_date_norm")
def bars_date_norm(spark, sf):
    return B.normalise_dates(td.raw_bars(spark, sf))


@query("bars_sorted")
def bars_sorted(spark, sf):
    """The layout itself: the partitions' bounds and whether any row is out of
    order within its partition or beyond the next partition's first row."""
    laid_out = B.sorted_layout(td.bars(spark, sf)).withColumn("at", F.monotonically_increasing_id())
    parts = laid_out.select("symbol", "date", "at", F.shiftright("at", 33).alias("part"))
    rows = F.struct("symbol", "date")
    by_place = Window.partitionBy("part").orderBy("at")
    checked = parts.withColumn("bad", F.coalesce(F.lag(rows).over(by_place) > rows, F.lit(False)))
    ends = checked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(rows).alias("low"), F.max(rows).alias("high"), F.max("bad").alias("bad"))
    after = F.lead("low").over(Window.orderBy("part"))  # one row a partition
    ends = ends.withColumn("beyond", F.coalesce(F.col("high") >= after, F.lit(False)))
    return ends.agg(F.sum("n").alias("records"), F.max(F.col("bad") | F.col("beyond")).alias("out_of_order"))


@query("series_by_symbol")
def series_by_symbol(spark, sf):
    return S.by_symbol(td.bars(spark, sf), "S1")


@query("series_range")
def series_range(spark, sf):
    return S.series(td.bars(spark, sf), "S1", "1996-01-01", "1996-12-31")


@query("unknown_symbols")
def unknown_symbols(spark, sf):
    lookups = td.raw(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol"))
    return S.unknown_symbols(lookups, td.bars(spark, sf)).select("request_id", "symbol")


@query("symbols_distinct")
def symbols_distinct(spark, sf):
    return S.symbols_distinct(td.bars(spark, sf))


@query("symbols_first_n")
def symbols_first_n(spark, sf):
    return S.symbols_first_n(td.bars(spark, sf), 20)


@query("date_range")
def date_range(spark, sf):
    return S.date_range(td.bars(spark, sf))


@query("dataset_info")
def dataset_info(spark, sf):
    return S.dataset_info(td.bars(spark, sf))


@query("symbol_profile")
def symbol_profile(spark, sf):
    return S.symbol_profile(td.bars(spark, sf))


@query("dataset_profile")
def dataset_profile(spark, sf):
    return S.dataset_profile(td.bars(spark, sf))


@query("date_range_stored")
def date_range_stored(spark, sf):
    """Range and records of a stored table, from its footers."""
    path = scratch_path(spark, "bars")
    B.write_bars(td.bars(spark, sf), path)
    return S.stored_range(spark, path)


# --- window kernels (O18-O22) -------------------------------------------------------

@query("rolling_mean")
def rolling_mean(spark, sf):
    b = K.in_blocks(_bars_close(spark, sf), halo=19)
    return K.out_of_blocks(b.withColumn("rolling_mean", K.rolling_mean("close", 20, K.block_window()))).drop("close")


@query("rolling_std")
def rolling_std(spark, sf):
    b = K.in_blocks(_bars_close(spark, sf), halo=19)
    return K.out_of_blocks(b.withColumn("rolling_std", r4(K.rolling_std("close", 20, K.block_window())))).drop("close")


@query("close_diff")
def close_diff(spark, sf):
    b = K.in_blocks(_bars_close(spark, sf), halo=1)
    return K.out_of_blocks(b.withColumn("close_diff", K.first_difference("close", K.block_window()))).drop("close")


@query("gain_loss")
def gain_loss(spark, sf):
    b = K.in_blocks(_bars_close(spark, sf), halo=1)
    b = K.out_of_blocks(b.withColumn("d", K.first_difference("close", K.block_window())))
    return b.select("symbol", "date", K.gain(F.col("d")).alias("gain"), K.loss(F.col("d")).alias("loss"))


@query("ewm_mean")
def ewm_mean(spark, sf):
    b = K.in_blocks(td.bars(spark, sf).select("symbol", "date", "high"), "high")
    out = K.out_of_blocks(K.ewm_means(b, [("high", 10, "ewm_mean")]))
    return out.select("symbol", "date", r4("ewm_mean").alias("ewm_mean"))


# --- indicators (O23-O28) -------------------------------------------------------------

def _bars_close(spark, sf):
    return td.bars(spark, sf).select("symbol", "date", "close")


@query("sma")
def sma(spark, sf):
    return I.sma(_bars_close(spark, sf), 20).select("symbol", "date", "sma")


@query("ema")
def ema(spark, sf):
    return I.ema(_bars_close(spark, sf), 20).select("symbol", "date", r4("ema").alias("ema"))


@query("rsi")
def rsi(spark, sf):
    return I.rsi(_bars_close(spark, sf), 14).select("symbol", "date", "rsi")


@query("macd")
def macd(spark, sf):
    m = I.macd(_bars_close(spark, sf), 12, 26, 9)
    return m.select("symbol", "date", r4("macd").alias("macd"), r4("signal").alias("signal"),
                    r4("histogram").alias("histogram"))


@query("bollinger")
def bollinger(spark, sf):
    bb = I.bollinger(_bars_close(spark, sf), 20, 2.0)
    return bb.select("symbol", "date", r4("upper").alias("upper"), "middle",
                     r4("lower").alias("lower"))


def suite_rounded(df: DataFrame) -> DataFrame:
    return df.select("symbol", "date", "sma", r4("ema").alias("ema"), "rsi",
                     r4("macd").alias("macd"), r4("macd_signal").alias("macd_signal"),
                     r4("macd_histogram").alias("macd_histogram"),
                     r4("bb_upper").alias("bb_upper"), "bb_middle",
                     r4("bb_lower").alias("bb_lower"))


@query("indicator_suite")
def indicator_suite(spark, sf):
    return suite_rounded(I.suite(_bars_close(spark, sf)))


# --- stored series (O3, O22, O28) ------------------------------------------------------

from ..operators import incremental as INC  # noqa: E402


def _blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    B.write_blocks(_bars_close(spark, sf), path)
    return B.read_blocks(spark, path)


@query("sma_stored")
def sma_stored(spark, sf):
    return I.sma(_blocks(spark, sf), 20).select("symbol", "date", "sma")


@query("suite_stored")
def suite_stored(spark, sf):
    return suite_rounded(I.suite(_blocks(spark, sf)))


APPENDED = ("1998-01-01", "1998-01-20", "1999-06-01")


@query("suite_appended")
def suite_appended(spark, sf):
    """The suite of the bars from 1998 on, appended in three steps to the
    state that the bars before have left."""
    path = scratch_path(spark, "bars")
    B.write_bars(_bars_close(spark, sf), path, by_year=True)
    bars = B.read_bars(spark, path)
    state, out = INC.suite_state(S.in_range(bars, end="1997-12-31")), []
    for start, end in zip(APPENDED, (*APPENDED[1:], None)):
        stored = scratch_path(spark, "state")
        state.write.parquet(stored)
        state = spark.read.schema(INC.STATE_SCHEMA).parquet(stored)
        new = S.in_range(bars, start, None if end is None else S.day_before(end))
        points, state = INC.append_suite(new, state, path=scratch_path(spark, "points"))
        out.append(suite_rounded(points))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- output shaping (O6, O29-O32) -------------------------------------------------------

from ..operators import shaping as SH  # noqa: E402


@query("sma_trimmed")
def sma_trimmed(spark, sf):
    s = I.sma(_bars_close(spark, sf), 20)
    return SH.trim_warmup(s, SH.warmup_rows("sma", {"window": 20})).select("symbol", "date", "sma")


@query("rsi_trimmed")
def rsi_trimmed(spark, sf):
    s = I.rsi(_bars_close(spark, sf), 14)
    return SH.trim_warmup(s, SH.warmup_rows("rsi", {"period": 14})).select("symbol", "date", "rsi")


@query("macd_trimmed")
def macd_trimmed(spark, sf):
    m = I.macd(_bars_close(spark, sf), 12, 26, 9)
    m = SH.fill_missing(SH.trim_warmup(m, SH.warmup_rows("macd", {"slow_period": 26})),
                        ["macd", "signal", "histogram"])
    return m.select("symbol", "date", r4("macd").alias("macd"), r4("signal").alias("signal"),
                    r4("histogram").alias("histogram"))


@query("bollinger_filled")
def bollinger_filled(spark, sf):
    """Trimmed bands, where nothing is left to fill."""
    bb = I.bollinger(_bars_close(spark, sf), 20, 2.0)
    bb = SH.fill_missing(SH.trim_warmup(bb, SH.warmup_rows("bollinger", {"period": 20})),
                         ["upper", "middle", "lower"])
    return bb.select("symbol", "date", r4("upper").alias("upper"), "middle",
                     r4("lower").alias("lower"))


@query("bollinger_period_one_filled")
def bollinger_period_one_filled(spark, sf):
    """Bands of one row have no deviation: all upper and lower values are filled."""
    bb = SH.fill_missing(I.bollinger(_bars_close(spark, sf), 1, 2.0), ["upper", "middle", "lower"])
    return bb.select("symbol", "date", "upper", "middle", "lower")


@query("bollinger_untrimmed_filled")
def bollinger_untrimmed_filled(spark, sf):
    """Untrimmed, the first row of each symbol is filled."""
    bb = SH.fill_missing(I.bollinger(_bars_close(spark, sf), 20, 2.0), ["upper", "middle", "lower"])
    return bb.select("symbol", "date", r4("upper").alias("upper"), "middle", r4("lower").alias("lower"))


@query("suite_long")
def suite_long(spark, sf):
    s = I.suite(_bars_close(spark, sf))
    long = SH.to_long(s, I.SUITE_COLUMNS)
    return long.select("symbol", "date", "indicator", r4("value").alias("value"))


# --- entitlement policy (O33-O39) -----------------------------------------------------------

from ..operators import policy as P  # noqa: E402

BARS_AS_OF = "1999-01-01"


@query("tier_entitlements")
def tier_entitlements(spark, sf):
    u = P.with_limits(td.users(spark, sf))
    return u.select("id", "tier", "tier_rank", "requests_per_day", "data_limit_days",
                    F.array_join("allowed_indicators", ",").alias("allowed"))


def _requests_with_tier(spark, sf):
    u = td.users(spark, sf).select(F.col("id").alias("user_id"), "tier")
    return td.requests(spark, sf).join(u, "user_id", "left")


@query("indicator_entitlement")
def indicator_entitlement(spark, sf):
    r = _requests_with_tier(spark, sf)
    return r.select("request_id", "tier", "indicator",
                    P.indicator_allowed(F.col("tier"), F.col("indicator")).alias("entitled"))


@query("tier_gate")
def tier_gate(spark, sf):
    r = _requests_with_tier(spark, sf)
    return r.select("request_id", "tier", "indicator",
                    P.tier_gate(F.col("tier"), F.col("indicator")).alias("gate_ok"))


@query("default_range")
def default_range(spark, sf):
    r = td.requests_open_ranges(spark, sf)
    s, e = P.default_range(F.col("start_date"), F.col("end_date"), BARS_AS_OF, 365)
    return r.select("request_id", s.alias("start_date"), e.alias("end_date"))


@query("clamp_range")
def clamp_range(spark, sf):
    from ..operators.requests import data_range
    r = P.with_limits(_requests_with_tier(spark, sf))
    d0, d1 = data_range(td.bars(spark, sf))
    s, e = P.clamp_range(F.col("start_date"), F.col("end_date"), F.col("data_limit_days"),
                         BARS_AS_OF, d0, d1)
    return r.select("request_id", "tier", s.alias("eff_start"), e.alias("eff_end"))


@query("reject_range")
def reject_range(spark, sf):
    r = P.with_limits(_requests_with_tier(spark, sf))
    swap = F.col("request_id") % 7 == 0
    s = F.when(swap, F.col("end_date")).otherwise(F.col("start_date"))
    e = F.when(swap, F.col("start_date")).otherwise(F.col("end_date"))
    return r.select("request_id", "tier",
                    P.reject_range(s, e, F.col("data_limit_days"), "1997-06-01").alias("status_code"))


@query("param_bounds")
def param_bounds(spark, sf):
    r = td.requests_with_params(spark, sf)
    ok = P.params_within_bounds(F.col("indicator"), F.col("params"))
    return r.select("request_id", "indicator", ok.alias("params_ok"),
                    F.when(ok, F.lit(200)).otherwise(F.lit(422)).alias("status_code"))


@query("param_bounds_alternate")
def param_bounds_alternate(spark, sf):
    r = td.requests_with_params(spark, sf)
    ok = P.params_within_bounds(F.col("indicator"), F.col("params"), P.ALTERNATE_BOUNDS)
    return r.select("request_id", "indicator", ok.alias("params_ok"))


# --- quotas (O40-O43) ------------------------------------------------------------------------

from ..operators import quota as Q  # noqa: E402


@query("quota_decision")
def quota_decision(spark, sf):
    r = Q.with_daily_limit(td.requests(spark, sf), td.users(spark, sf), P.TEST_POLICY)
    d = Q.quota_decision(r)
    return d.select("request_id", "user_id", "day", "allowed", "used", "remaining", "reset_date")


@query("quota_remaining_shared")
def quota_remaining_shared(spark, sf):
    """What the limiter with shared counters reports: unlimited tiers as a large number."""
    r = Q.with_daily_limit(td.requests(spark, sf), td.users(spark, sf), P.TEST_POLICY)
    return Q.quota_decision(r, unlimited_remaining=Q.SHARED_UNLIMITED).select("request_id", "remaining")


@query("quota_usage")
def quota_usage(spark, sf):
    return Q.quota_usage(td.requests(spark, sf), td.users(spark, sf), P.TEST_POLICY)


@query("quota_counters")
def quota_counters(spark, sf):
    return Q.consumed_counters(td.requests(spark, sf), td.users(spark, sf), P.TEST_POLICY).select("user_id", "day", "requests")


@query("quota_retention")
def quota_retention(spark, sf):
    kept = Q.quota_retention(td.requests(spark, sf), td.users(spark, sf), "2024-01-30 12:00:00", 24, P.TEST_POLICY)
    return kept.select("user_id", "day", "requests")


# --- identity (O46-O48) ------------------------------------------------------------------------

from ..operators import identity as ID  # noqa: E402


@query("resolve_keys")
def resolve_keys(spark, sf):
    out = ID.resolve_keys(td.key_requests(spark, sf), td.api_keys(spark, sf), td.users(spark, sf))
    return out.select("request_id", "api_key", "reason", "user_id", "status_code")


@query("key_listing")
def key_listing(spark, sf):
    return ID.key_listing(td.api_keys(spark, sf)).select("user_id", "id", "key_hint", "is_active")


def _revocations(spark, sf):
    return td.raw(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("key_id"))


@query("key_revocations")
def key_revocations(spark, sf):
    """Every event's user revokes the key of its number: most are someone else's."""
    _, told = ID.deactivate_keys(td.api_keys(spark, sf), _revocations(spark, sf))
    return told.select("event_id", "status_code")


@query("keys_after_revocations")
def keys_after_revocations(spark, sf):
    after, _ = ID.deactivate_keys(td.api_keys(spark, sf), _revocations(spark, sf))
    return after.select("id", "user_id", "is_active")


@query("intake_conflicts")
def intake_conflicts(spark, sf):
    out = ID.intake_check(td.intake_candidates(spark, sf), td.users(spark, sf))
    return out.select("candidate_id", "username", "email", "status", "tier")


# --- materialised results (O49-O52) ---------------------------------------------------------------

from ..operators import results as RS  # noqa: E402
from ..operators import store as ST  # noqa: E402


def _cache_entries(spark, sf):
    """The cache as the request stream writes it: one entry per request,
    keyed by its parameter key, written at the request's time."""
    r = td.requests(spark, sf)
    key = RS.params_key(F.col("symbol"), F.col("indicator"), F.col("params"),
                        F.col("start_date"), F.col("end_date"))
    return r.select("request_id", key.alias("params_key"), F.col("ts").alias("cached_at"))


@query("params_key")
def params_key(spark, sf):
    return _cache_entries(spark, sf).select("request_id", "params_key")


@query("fresh_results")
def fresh_results(spark, sf):
    live = RS.fresh(_cache_entries(spark, sf), "2024-01-30 00:00:00", ttl_minutes=1440)
    return RS.newest_per_key(live, ["request_id"]).select("params_key", "request_id")


@query("results_read_through")
def results_read_through(spark, sf):
    """Requests of every third event look for entries that the others wrote."""
    every = _cache_entries(spark, sf)
    asked = every.where(F.col("request_id") % 3 == 0).select("params_key", "request_id")
    stored = every.where(F.col("request_id") % 3 != 0).withColumn("value", F.col("request_id"))
    computed = lambda missing: missing.withColumn("value", F.lit(-1).cast("long"))
    out = RS.read_through(asked, stored, computed, "2024-01-30 00:00:00", 20 * 1440, order=("cached_at", "request_id"))
    return out.select("params_key", "hit", "value")


@query("cache_hits")
def cache_hits(spark, sf):
    """Hits and misses per indicator of every third event's request."""
    every = _cache_entries(spark, sf)
    return RS.hit_counts(every.where(F.col("request_id") % 3 == 0), every.where(F.col("request_id") % 3 != 0), "2024-01-30 00:00:00", 20 * 1440)


def _store(spark, sf):
    """A stored cache: even requests appended, one glob deleted, odd requests appended."""
    path = scratch_path(spark, "store")
    rows = _cache_entries(spark, sf).withColumn("indicator", F.lower(F.split_part("params_key", F.lit(":"), F.lit(3)))).drop("cached_at")
    ST.append(rows.where(F.col("request_id") % 2 == 0), path, "2024-01-01 00:00:00")
    ST.invalidate(spark, path, "indicator:S?:[SE]MA:*")
    ST.append(rows.where(F.col("request_id") % 2 == 1), path, "2024-01-02 00:00:00")
    return path


@query("store_after_invalidation")
def store_after_invalidation(spark, sf):
    path = _store(spark, sf)
    ST.compact(spark, path)
    return ST.read(spark, path).select("request_id", "params_key", "indicator", F.to_date("cached_at").alias("cached_on"))


@query("store_lookup")
def store_lookup(spark, sf):
    """A glob over a stored cache: its prefix reaches the scan."""
    path = _store(spark, sf)
    return RS.matching(ST.read(spark, path), "indicator:S1:*").select("request_id", "params_key")


@query("invalidate_count")
def invalidate_count(spark, sf):
    keys = RS.matching(_cache_entries(spark, sf), "indicator:S[1-3]:*")
    return keys.agg(F.count_distinct("params_key").alias("deleted"))


@query("invalidate_rest")
def invalidate_rest(spark, sf):
    return RS.invalidate(_cache_entries(spark, sf), "indicator:S?:[SE]MA:*").select("params_key", "request_id")


@query("invalidate_matches")
def invalidate_matches(spark, sf):
    return RS.matching(_cache_entries(spark, sf), "indicator:S1:*").select("params_key", "request_id")


# --- request tables (O53-O54) and request log (O55) --------------------------------------------------

from ..operators import logs as LG  # noqa: E402
from ..operators import rangeindex as RI  # noqa: E402
from ..operators import requests as RQ  # noqa: E402


def _status(spark, sf, index):
    return RQ.request_status(td.requests_mixed(spark, sf), td.users(spark, sf), None,
                             BARS_AS_OF, P.TEST_POLICY, api_keys=td.api_keys(spark, sf), index=index)


def _index(spark, sf):
    return RI.stored_index(_bars_close(spark, sf))


@query("batch_request_status")
def batch_request_status(spark, sf):
    return _status(spark, sf, _index(spark, sf)).select("request_id", "status_code", "reason", "eff_start", "eff_end", "points")


def _accepted(spark, sf, index):
    """Accepted requests, stored: the gates are computed once for all that reads them."""
    path = scratch_path(spark, "accepted")
    accepted = _status(spark, sf, index).where(F.col("status_code") == 200)
    accepted.write.parquet(path)
    return spark.read.schema(accepted.schema).parquet(path)


@query("batch_evaluate")
def batch_evaluate(spark, sf):
    """Default range, clamp and gates, then every accepted request's points by its own parameters."""
    index = _index(spark, sf)
    out = RQ.evaluate(_accepted(spark, sf, index), None, "eff_start", "eff_end", index)
    return out.select("request_id", "date", *[r4(c).alias(c) for c in RQ.POINTS])


def _documents(spark, sf, indicator, title, columns, parameters):
    """Documents of one endpoint: accepted requests, points in date order."""
    index = _index(spark, sf)
    accepted = RQ.resolved(_accepted(spark, sf, index)).where(F.col("indicator") == indicator)
    points = RQ.evaluate(accepted, None, "eff_start", "eff_end", index, [indicator], nested=True)
    points = points.select("request_id", F.transform("points", lambda p: F.struct(p["date"].alias("date"), *[F.round(p[c], 4).alias(c) for c in columns])).alias("points"))
    head = accepted.select("request_id", "symbol", F.lit(title).alias("indicator"), parameters.alias("parameters"),
                           F.col("eff_start").alias("start_date"), F.col("eff_end").alias("end_date"))
    docs = SH.documents(head.join(points, "request_id"), columns)
    line = F.aggregate("data", F.lit(""), lambda acc, p: F.concat(acc, F.concat_ws(
        "|", p["date"].cast("string"), *[F.when(p[c].isNull(), F.lit("null")).otherwise(F.format_string("%.4f", p[c] + F.lit(0.0))) for c in columns]), F.lit(";")))
    shown = F.concat_ws(",", F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.1f", e["value"]))))
    return docs.select("request_id", "symbol", "indicator", shown.alias("parameters"), "data_points", "start_date", "end_date", F.md5(line).alias("data_md5"))


def _values(**names):
    return F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("double"))])


@query("indicator_documents")
def indicator_documents(spark, sf):
    return _documents(spark, sf, "sma", "SMA", ["value"], _values(window="__p1"))


@query("macd_documents")
def macd_documents(spark, sf):
    return _documents(spark, sf, "macd", "MACD", ["macd", "signal", "histogram"], _values(fast_period="__p1", slow_period="__p2", signal_period="__p3"))


@query("bollinger_documents")
def bollinger_documents(spark, sf):
    return _documents(spark, sf, "bollinger", "Bollinger Bands", ["upper", "middle", "lower"], _values(period="__p1", std_dev="__k"))


def _batch(spark, sf, indicator):
    r = td.requests(spark, sf).where(F.col("indicator") == indicator)
    return RQ.evaluate(r, td.bars(spark, sf), indicators=[indicator])


@query("batch_sma")
def batch_sma(spark, sf):
    return _batch(spark, sf, "sma").select("request_id", "date", F.col("value").alias("sma"))


@query("batch_ema")
def batch_ema(spark, sf):
    return _batch(spark, sf, "ema").select("request_id", "date", r4("value").alias("ema"))


@query("batch_rsi")
def batch_rsi(spark, sf):
    return _batch(spark, sf, "rsi").select("request_id", "date", r4("value").alias("rsi"))


@query("batch_macd")
def batch_macd(spark, sf):
    m = _batch(spark, sf, "macd")
    return m.select("request_id", "date", r4("macd").alias("macd"), r4("signal").alias("signal"),
                    r4("histogram").alias("histogram"))


@query("batch_bollinger")
def batch_bollinger(spark, sf):
    bb = _batch(spark, sf, "bollinger")
    return bb.select("request_id", "date", r4("upper").alias("upper"), "middle",
                     r4("lower").alias("lower"))


@query("request_log_rollup")
def request_log_rollup(spark, sf):
    out = LG.rollup(td.request_log(spark, sf), exact=True)
    return out.select("endpoint", "day", "requests", "avg_ms", r4("p50_ms").alias("p50_ms"),
                      r4("p95_ms").alias("p95_ms"), "error_ratio")


@query("request_log_rollup_approx")
def request_log_rollup_approx(spark, sf):
    """The scale path: at 10,000 values a group the sketch is exact for smaller
    groups, and gives a value of the column (nearest rank)."""
    out = LG.rollup(td.request_log(spark, sf), exact=False)
    return out.select("endpoint", "day", "requests", "p50_ms", "p95_ms")


@query("request_log_rollup_weekly")
def request_log_rollup_weekly(spark, sf):
    """Weeks from stored days: the log is read once, for the days."""
    path = scratch_path(spark, "log-days")
    LG.daily_sketches(td.request_log(spark, sf)).write.parquet(path)
    return LG.merged_rollup(spark.read.parquet(path))


# --- streaming (O44-O45) -----------------------------------------------------------------------

from ..streaming import quota_stream as QS  # noqa: E402


def _request_stream(spark, sf):
    events = QS.read_event_stream(spark, sf, glob="events.parquet")
    return td.requests_from_events(events)


@query("stream_quota_counts")
def stream_quota_counts(spark, sf):
    counts = QS.daily_counts_stream(_request_stream(spark, sf), td.users(spark, sf), P.TEST_POLICY)
    return QS.run_counts(spark, counts, "stream-quota-counts")


@query("stream_quota_decision")
def stream_quota_decision(spark, sf):
    dec = QS.decisions_stream(_request_stream(spark, sf), td.users(spark, sf), P.TEST_POLICY)
    return QS.run_to_parquet(spark, dec, "stream-quota-decision")
