"""Whole tables of indicator requests.

``request_status`` applies the endpoint's gate order to every request at
once; ``evaluate`` computes each accepted request's points over its *own*
truncated series (V1) with its *own* parameters, all indicators and requests
in one job.

The request -> bars match of ``evaluate`` is an equi-join on (symbol, year) with
the range index (``rangeindex``): each distinct range is exploded into the few
calendar years it spans and takes its slice of each. ``range_join`` gives the
bars themselves. Equal ranges are matched once, and tables of one row per range
go back to the requests by ``skew.spread_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as N
from ..operators import indicators as I
from . import identity as ID
from . import rangeindex as RI
from .policy import DEFAULT_POLICY, PARAM_BOUNDS, REQUIRED_TIER, clamp_range, default_range, indicator_allowed, params_within_bounds, tier_gate, tier_limits
from .quota import day_of
from .skew import apart, first_n, spread_join

SHARED_BY = 4096  # requests that read one copy of a range's points


def range_join(requests: DataFrame, bars: DataFrame, start_col: str = "start_date",
               end_col: str = "end_date", symbol_col: str = "symbol") -> DataFrame:
    """Every (request, bar) with the bar's date inside the request's range; an
    open end (NULL) reaches to the first or last bar."""
    first, last = data_range(bars)
    s, e = F.coalesce(F.col(start_col), first), F.coalesce(F.col(end_col), last)
    r = requests.withColumns({"__s": s, "__e": e})
    s, e = F.col("__s"), F.col("__e")
    r = r.where(s <= e).withColumn("__bucket", F.explode(F.sequence(F.year(s), F.year(e))))
    b = bars.withColumnRenamed(symbol_col, "__bar_symbol").withColumn("__bucket", F.year("date"))
    joined = r.join(b, (r[symbol_col] == b["__bar_symbol"]) & (r["__bucket"] == b["__bucket"]))
    return (joined.where((F.col("date") >= s) & (F.col("date") <= e))
                  .drop("__bucket", "__bar_symbol", "__s", "__e"))


def data_range(bars: DataFrame):
    """Global first and last bar date, from one scalar subquery."""
    ends = bars.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last")).alias("r")).scalar()
    return ends["first"], ends["last"]


def identified(requests: DataFrame, users: DataFrame, api_keys: DataFrame | None = None) -> DataFrame:
    """Requests with the user that they act for (an API key decides, if one is
    presented), the tier, and whether that user is known and active."""
    r = requests
    if api_keys is not None and "api_key" in r.columns:
        key = F.when(ID.key_format_ok(F.col("api_key")), F.col("api_key"))
        active = api_keys.where(F.col("is_active") & ID.key_format_ok(F.col("key"))).select(F.col("key").alias("__key"), F.col("user_id").alias("__key_user"))
        r = (r.withColumn("__key", key).withColumn("__key", apart("__key", "request_id")).join(active, "__key", "left")
             .withColumn("user_id", F.when(F.col("api_key").isNull(), F.col("user_id")).otherwise(F.col("__key_user"))).drop("__key", "__key_user"))
    u = users.select(F.col("id").cast("string").alias("__user"), F.col("is_active").alias("__active"), "tier")
    r = r.withColumn("__user", apart("user_id", "request_id")).join(u, "__user", "left").drop("__user")
    return r.withColumn("__identity", F.coalesce("__active", F.lit(False))).drop("__active")


def _points(ranges: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars within each (symbol, eff_start, eff_end): whole months by their
    counts, the months at both ends by their days."""
    months = (bars.select("symbol", F.date_trunc("month", "date").cast("date").alias("__month"), F.dayofmonth("date").alias("d"))
              .groupBy("symbol", "__month", "d").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("symbol", "__month").agg(F.collect_list(F.struct("d", "n")).alias("__days")))  # 31 at most
    s, e = F.col("eff_start"), F.col("eff_end")
    spread = ranges.where(s <= e).withColumn("__month", F.explode(F.sequence(F.trunc(s, "month"), F.trunc(e, "month"), F.expr("interval 1 month"))))
    low = F.when(F.col("__month") == F.trunc(s, "month"), F.dayofmonth(s)).otherwise(1)
    high = F.when(F.col("__month") == F.trunc(e, "month"), F.dayofmonth(e)).otherwise(31)
    met = spread.withColumns({"__low": low, "__high": high}).join(months, ["symbol", "__month"])
    inside = F.aggregate(F.filter("__days", lambda x: x["d"].between(F.col("__low"), F.col("__high"))), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return met.groupBy("symbol", "eff_start", "eff_end").agg(F.sum(inside).alias("points"))


def request_status(requests: DataFrame, users: DataFrame, bars: DataFrame | None, as_of,
                   policy=DEFAULT_POLICY, default_days: int = 365, api_keys: DataFrame | None = None,
                   bounds=PARAM_BOUNDS, index: DataFrame | None = None) -> DataFrame:
    """Unknown indicator 404 -> identity 401 -> tier 403 -> bounds 422 ->
    quota 429 (consuming) -> range clamp -> unknown symbol 404 -> empty range
    404 -> 200.

    Only requests that pass identity, tier and bounds take part in the
    quota ranking, as only they reach the limiter. ``index``: a range index of
    the bars, which answers for them.
    """
    r = identified(requests, users, api_keys)
    lim = tier_limits(F.col("tier"), policy)
    known_indicator = F.coalesce(F.lower("indicator").isin(*REQUIRED_TIER), F.lit(False))
    gate = (F.when(~known_indicator, F.lit("unknown_indicator"))
            .when(~F.col("__identity"), F.lit("unauthenticated"))
            .when(~(tier_gate(F.col("tier"), F.col("indicator"), policy) & indicator_allowed(F.col("tier"), F.col("indicator"), policy)), F.lit("tier"))
            .when(~params_within_bounds(F.col("indicator"), F.col("params"), bounds), F.lit("bounds")))
    d0, d1 = data_range(bars) if index is None else RI.index_range(index)
    s, e = default_range(F.col("start_date"), F.col("end_date"), as_of, default_days)
    cs, ce = clamp_range(s, e, lim["data_limit_days"], as_of, d0, d1)
    r = r.withColumns({"__gate": gate, "daily_limit": lim["requests_per_day"], "eff_start": cs, "eff_end": ce, "__day": day_of(F.col("ts"))})

    contest = r.where(F.col("__gate").isNull() & F.col("daily_limit").isNotNull()).select("request_id", "user_id", "__day", "ts", "daily_limit")
    winners = first_n(contest, ["user_id", "__day"], ["ts", "request_id"], "daily_limit", "request_id").select("request_id", F.lit(True).alias("__won"))
    r = r.join(winners, "request_id", "left")
    r = r.withColumn("__gate", F.coalesce("__gate", F.when(F.col("daily_limit").isNotNull() & F.col("__won").isNull(), F.lit("quota"))))

    known = (bars if index is None else index).select("symbol").distinct().withColumn("__known", F.lit(True))
    r = spread_join(r, known, ["symbol"], "request_id")
    ranges = r.where(F.col("__gate").isNull() & F.col("__known")).select("symbol", "eff_start", "eff_end").distinct()
    found = _points(ranges, bars) if index is None else RI.counts(ranges, index, "eff_start", "eff_end")
    r = spread_join(r, found, ["symbol", "eff_start", "eff_end"], "request_id")
    points = F.coalesce("points", F.lit(0))
    reason = F.coalesce("__gate", F.when(F.col("__known").isNull(), F.lit("unknown_symbol")).when(points == 0, F.lit("empty_range")).otherwise(F.lit("ok")))
    codes = {"unauthenticated": 401, "tier": 403, "bounds": 422, "quota": 429, "ok": 200}
    status = F.lit(404)
    for name, code in codes.items():
        status = F.when(F.col("reason") == name, F.lit(code)).otherwise(status)
    r = r.withColumn("reason", reason).withColumn("status_code", status)
    return r.select("request_id", "user_id", "symbol", "indicator", "params", "tier", "status_code", "reason",
                    "eff_start", "eff_end", F.when(F.col("status_code") == 200, points).otherwise(F.lit(0)).alias("points"))


# --- evaluation with each request's own parameters ---------------------------------------


def _number(params: Column, names: dict[str, str], default: dict[str, float], indicator: Column, kind: str) -> Column:
    """The parameter that each indicator takes for a role, or its default."""
    out = F.lit(None).cast(kind)
    for ind, name in names.items():
        out = F.when(indicator == ind, F.coalesce(F.try_element_at(params, F.lit(name)).try_cast(kind), F.lit(default[ind]).cast(kind))).otherwise(out)
    return out


def resolved(requests: DataFrame) -> DataFrame:
    """Requests with ``indicator`` in lower case and their parameters as
    columns: __p1 (window, period or fast period), __p2 (slow), __p3 (signal),
    __k (multiplier); a missing one takes its default."""
    d = I.DEFAULTS
    ind, params = F.col("indicator"), F.coalesce("params", F.create_map().cast("map<string,string>"))
    roles = {"sma": "window", "ema": "window", "rsi": "period", "macd": "fast_period", "bollinger": "period"}
    r = requests.withColumn("indicator", F.lower("indicator"))
    return r.withColumns({
        "__p1": _number(params, roles, {i: d[i][n] for i, n in roles.items()}, ind, "int"),
        "__p2": _number(params, {"macd": "slow_period"}, {"macd": d["macd"]["slow_period"]}, ind, "int"),
        "__p3": _number(params, {"macd": "signal_period"}, {"macd": d["macd"]["signal_period"]}, ind, "int"),
        "__k": _number(params, {"bollinger": "std_dev"}, {"bollinger": d["bollinger"]["std_dev"]}, ind, "double")})


POINTS = ("value", "macd", "signal", "histogram", "upper", "middle", "lower")


def evaluate(requests: DataFrame, bars: DataFrame | None = None, start_col: str = "start_date", end_col: str = "end_date",
             index: DataFrame | None = None, indicators=tuple(N.COLUMNS), nested: bool = False) -> DataFrame:
    """The points of every request: (request_id, date, ``POINTS``); value
    holds sma, ema and rsi. ``nested``: one row a request instead, (request_id,
    points), with the points in date order and the indicators' columns only.

    ``requests`` are accepted ones: (request_id, symbol, indicator, params,
    range); a window, period or span below 1 gives no points. Equal (symbol,
    range, indicator, parameters) are computed once, each from its own rows
    only (V1), out of the range index: ``index``, or one made of ``bars`` for
    this call. Parameters vary by row and have no upper bound. ``indicators``:
    those to evaluate; requests of others give no points.
    """
    index = RI.stored_index(bars) if index is None else index
    ident = ["symbol", start_col, end_col, "indicator", "__p1", "__p2", "__p3", "__k"]
    key = F.unhex(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ident]), 256))
    r = resolved(requests)
    sound = (F.col("__p1") >= 1) & F.coalesce(F.col("__p2") >= 1, F.lit(True)) & F.coalesce(F.col("__p3") >= 1, F.lit(True))
    r = r.where(sound & F.col("indicator").isin(*indicators)).select("request_id", key.alias("__key"), *ident)
    # A range that very many requests share is copied, and its requests are dealt over the copies.
    shared = (r.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SHARED_BY)
              .select("__key", F.ceil(F.col("__n") / F.lit(SHARED_BY)).cast("int").alias("__copies")))  # few rows
    copy = F.coalesce(F.pmod(F.xxhash64("request_id"), F.col("__copies")).cast("int"), F.lit(0))
    asked = (r.join(shared, "__key", "left").withColumn("__copy", copy).groupBy("__key", "__copy")
             .agg(F.collect_list("request_id").alias("ids"), *[F.any_value(c).alias(c) for c in ident]))
    found = RI.slices(asked, index, start_col, end_col, ["__key", "__copy"])
    columns = [c for c in POINTS if any(c in N.COLUMNS[i] for i in indicators)]
    out = RI.points(found.withColumnsRenamed({"__p1": "p1", "__p2": "p2", "__p3": "p3", "__k": "k"}), columns, nested)
    if nested:
        return out
    return out.select("request_id", "date", *[F.col(c) if c in columns else F.lit(None).cast("double").alias(c) for c in POINTS])
