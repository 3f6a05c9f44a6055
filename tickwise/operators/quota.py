"""Daily quota accounting over a request table.

Semantics (live limiter): per (user, UTC calendar day) a request is allowed
iff the number of *previously allowed* requests is below the tier's limit;
rejected requests consume nothing, so "allowed" is exactly "among the first
``limit`` requests of the day". Unlimited tiers are always allowed and
report ``used = 0``.

Scale: one user-day may hold a large share of all requests. The decision is
therefore a ranking in two steps (``skew.first_n``), each cut by the row's own
limit; the winners are joined back on the unique ``request_id``. Counts per
user-day are plain partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import DEFAULT_POLICY, tier_limits
from .skew import first_n

SHARED_UNLIMITED = 999999  # fixed value of the limiter with shared counters


def day_of(ts: Column) -> Column:
    """The UTC calendar day of a timestamp, whatever the session's zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def with_daily_limit(requests: DataFrame, users: DataFrame, policy=DEFAULT_POLICY,
                     user_col: str = "user_id") -> DataFrame:
    """Attach the requesting user's tier and daily limit (users is joined on
    its unique id; a hot user's side can be split at run time)."""
    u = users.select(F.col("id").alias(user_col), F.col("tier"))
    out = requests.join(u, user_col, "left")
    return out.withColumn("daily_limit", tier_limits(F.col("tier"), policy)["requests_per_day"])


def quota_decision(requests: DataFrame, limit_col: str = "daily_limit",
                   user_col: str = "user_id", ts_col: str = "ts",
                   id_col: str = "request_id", unlimited_remaining: int | None = None) -> DataFrame:
    """O40 + O41 per request: allowed, used (count before the check),
    remaining (before the check, as the limiter reports it) and the reset
    date (next midnight) for blocked requests. ``unlimited_remaining``: what
    unlimited tiers are told (null, or the shared counters' 999999)."""
    req = requests.withColumn("day", day_of(F.col(ts_col)))
    limited = req.where(F.col(limit_col).isNotNull()).select(user_col, "day", ts_col, id_col, limit_col)
    winners = first_n(limited, [user_col, "day"], [ts_col, id_col], limit_col, id_col).select(id_col, "__rank")
    out = req.join(winners, id_col, "left")
    limit = F.col(limit_col)
    unlimited = limit.isNull()
    allowed = unlimited | F.col("__rank").isNotNull()
    return (out.withColumns({
                "allowed": allowed,
                "used": F.when(unlimited, F.lit(0))
                         .when(F.col("__rank").isNotNull(), F.col("__rank") - 1)
                         .otherwise(limit).cast("int"),
                "remaining": F.when(unlimited, F.lit(unlimited_remaining).cast("int"))
                              .when(F.col("__rank").isNotNull(), limit - F.col("__rank") + 1)
                              .otherwise(F.lit(0)).cast("int"),
                "reset_date": F.when(~allowed, F.date_add(F.col("day"), 1)),
            })
            .drop("__rank"))


def daily_counts(requests: DataFrame, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Requests and first use per (user, day) — a partial aggregate."""
    return (requests.groupBy(user_col, day_of(F.col(ts_col)).alias("day"))
                    .agg(F.count(F.lit(1)).alias("requests"),
                         F.min(ts_col).alias("first_ts")))


def with_user_limit(counts: DataFrame, users: DataFrame, policy=DEFAULT_POLICY, user_col: str = "user_id") -> DataFrame:
    u = users.select(F.col("id").alias(user_col), "tier")
    return counts.join(u, user_col, "left").withColumn("daily_limit", tier_limits(F.col("tier"), policy)["requests_per_day"])


def quota_usage(requests: DataFrame, users: DataFrame, policy=DEFAULT_POLICY,
                user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """O42 per user and day: tier, limit, used (allowed requests; 0 for
    unlimited tiers), remaining, and the reset date when the day is used up."""
    out = with_user_limit(daily_counts(requests, user_col, ts_col), users, policy, user_col)
    limit = F.col("daily_limit")
    used = F.when(limit.isNull(), F.lit(0)).otherwise(F.least(F.col("requests").cast("int"), limit))
    return out.select(
        user_col, "day", "tier",
        limit.alias("daily_limit"),
        used.alias("used"),
        F.when(limit.isNotNull(), F.greatest(limit - used, F.lit(0))).alias("remaining"),
        F.when(limit.isNotNull() & (used >= limit), F.date_add(F.col("day"), 1)).alias("reset_date"),
    )


def consumed_counters(requests: DataFrame, users: DataFrame, policy=DEFAULT_POLICY,
                      user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """The limiter's counters: allowed requests per (user, day) - rejected ones
    consume nothing, unlimited tiers count all - and the first use. A limit of
    0 leaves no counter."""
    out = with_user_limit(daily_counts(requests, user_col, ts_col), users, policy, user_col)
    used = F.least(F.col("requests"), F.col("daily_limit").cast("long"))  # no limit drops out
    return out.select(user_col, "day", used.alias("requests"), "first_ts").where(F.col("requests") > 0)


def quota_retention(requests: DataFrame, users: DataFrame, as_of, hours: int = 24, policy=DEFAULT_POLICY,
                    user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Counters first used within ``hours`` before ``as_of``. A counter's
    day is never before its first use's, so older days are left out at the scan."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    midnight = F.date_trunc("day", cutoff)
    recent = requests.where(F.col(ts_col) >= midnight)
    return consumed_counters(recent, users, policy, user_col, ts_col).where(F.col("first_ts") >= cutoff)
