"""Entitlement policy as data and as columns.

The tier table has a handful of fixed rows, so lookups are literal-map
expressions evaluated inside whole-stage codegen: no join, no broadcast,
no shuffle.

Unknown tiers fall back to the free row everywhere (the reference gives
them four different meanings; SURVEY §7.4 records the decision).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    name: str
    rank: int
    requests_per_day: int | None
    data_limit_days: int | None
    allowed: tuple[str, ...]


# Fixed values of the live service: requests/day, history days, indicators.
DEFAULT_POLICY = (
    Tier("free", 0, 50, 90, ("sma", "ema")),
    Tier("pro", 1, 500, 365, ("sma", "ema", "rsi", "macd")),
    Tier("premium", 2, None, None, ("sma", "ema", "rsi", "macd", "bollinger")),
)

# Same entitlements with daily limits small enough for the fixture events.
TEST_POLICY = (
    Tier("free", 0, 2, 90, ("sma", "ema")),
    Tier("pro", 1, 5, 365, ("sma", "ema", "rsi", "macd")),
    Tier("premium", 2, None, None, ("sma", "ema", "rsi", "macd", "bollinger")),
)

FALLBACK_TIER = "free"

# Minimum tier per indicator (rank gate of the live router).
REQUIRED_TIER = {"sma": "free", "ema": "free", "rsi": "pro", "macd": "pro", "bollinger": "premium"}

# Parameter bounds of the live endpoints (lo, hi, integer?). The
# functions below take other bounds or policies as arguments.
PARAM_BOUNDS = {
    ("sma", "window"): (1, 200, True),
    ("ema", "window"): (1, 200, True),
    ("rsi", "period"): (1, 100, True),
    ("macd", "fast_period"): (1, 100, True),
    ("macd", "slow_period"): (1, 200, True),
    ("macd", "signal_period"): (1, 100, True),
    ("bollinger", "period"): (1, 200, True),
    ("bollinger", "std_dev"): (0.1, 5.0, False),
}


# The alternate endpoints' bounds, where they differ.
ALTERNATE_BOUNDS = PARAM_BOUNDS | {
    ("macd", "fast_period"): (1, 50, True),
    ("macd", "signal_period"): (1, 50, True),
}


def _struct(t: Tier) -> Column:
    return F.struct(
        F.lit(t.name).alias("tier"),
        F.lit(t.rank).cast("int").alias("tier_rank"),
        F.lit(t.requests_per_day).cast("int").alias("requests_per_day"),
        F.lit(t.data_limit_days).cast("int").alias("data_limit_days"),
        F.array(*[F.lit(a) for a in t.allowed]).cast("array<string>").alias("allowed"),
    )


def tier_limits(tier: Column, policy=DEFAULT_POLICY) -> Column:
    """O33 lookup: the policy struct of a tier, the free row for unknown ones."""
    table = F.create_map(*[x for t in policy for x in (F.lit(t.name), _struct(t))])
    fallback = next(t for t in policy if t.name == FALLBACK_TIER)
    return F.coalesce(F.try_element_at(table, tier), _struct(fallback))


def with_limits(df: DataFrame, tier_col: str = "tier", policy=DEFAULT_POLICY,
                prefix: str = "") -> DataFrame:
    lim = tier_limits(F.col(tier_col), policy)
    return df.withColumns({
        prefix + "tier_rank": lim["tier_rank"],
        prefix + "requests_per_day": lim["requests_per_day"],
        prefix + "data_limit_days": lim["data_limit_days"],
        prefix + "allowed_indicators": lim["allowed"],
    })


def indicator_allowed(tier: Column, indicator: Column, policy=DEFAULT_POLICY) -> Column:
    """lower(indicator) is in the tier's list."""
    return F.array_contains(tier_limits(tier, policy)["allowed"], F.lower(indicator))


def _rank_of(name_col: Column, policy) -> Column:
    table = F.create_map(*[x for t in policy for x in (F.lit(t.name), F.lit(t.rank))])
    return F.coalesce(F.try_element_at(table, name_col), F.lit(0))


def tier_gate(tier: Column, indicator: Column, policy=DEFAULT_POLICY) -> Column:
    """User rank >= rank of the tier the indicator requires; unknown
    tiers rank 0."""
    req_map = F.create_map(*[x for k, v in REQUIRED_TIER.items() for x in (F.lit(k), F.lit(v))])
    required = F.try_element_at(req_map, F.lower(indicator))
    return _rank_of(tier, policy) >= _rank_of(required, policy)


def default_range(start: Column, end: Column, as_of, days: int = 365):
    """End defaults to ``as_of``; start to end - ``days`` (365 live,
    90 in the alternate endpoints)."""
    end_eff = F.coalesce(end, F.lit(as_of).cast("date"))
    start_eff = F.coalesce(start, F.date_sub(end_eff, days))
    return start_eff, end_eff


def clamp_range(start: Column, end: Column, limit_days: Column, as_of,
                data_start: Column, data_end: Column):
    """start = max(start, as_of - limit, data_start); end = min(end,
    data_end). An unlimited (NULL) limit drops out of ``greatest``; the result
    may be an empty range (start > end)."""
    earliest = F.date_sub(F.lit(as_of).cast("date"), limit_days)
    return F.greatest(start, earliest, data_start), F.least(end, data_end)


def reject_range(start: Column, end: Column, limit_days: Column, as_of) -> Column:
    """O38 (alternate endpoints): 400 if start > end, 403 if start is older
    than the tier allows, else 200."""
    earliest = F.date_sub(F.lit(as_of).cast("date"), limit_days)
    return (F.when(start > end, F.lit(400))
            .when(limit_days.isNotNull() & (start < earliest), F.lit(403))
            .otherwise(F.lit(200)))


def params_within_bounds(indicator: Column, params: Column, bounds=PARAM_BOUNDS) -> Column:
    """Every known parameter parses and lies within its bounds; a
    missing parameter takes its (valid) default. Unknown names are ignored,
    as query strings ignore unknown arguments."""
    lo_map = F.create_map(*[x for (i, p), (lo, hi, _) in bounds.items()
                            for x in (F.lit(f"{i}.{p}"), F.lit(float(lo)))])
    hi_map = F.create_map(*[x for (i, p), (lo, hi, _) in bounds.items()
                            for x in (F.lit(f"{i}.{p}"), F.lit(float(hi)))])
    int_map = F.create_map(*[x for (i, p), (_, _, is_int) in bounds.items()
                             for x in (F.lit(f"{i}.{p}"), F.lit(is_int))])
    ind = F.lower(indicator)

    def ok(acc, e):
        name = F.concat(ind, F.lit("."), e["key"])
        lo = F.try_element_at(lo_map, name)
        hi = F.try_element_at(hi_map, name)
        as_num = F.when(F.try_element_at(int_map, name),
                        e["value"].try_cast("int").cast("double")) \
                  .otherwise(e["value"].try_cast("double"))
        good = F.when(lo.isNull(), F.lit(True)).otherwise(
            F.coalesce(as_num.between(lo, hi), F.lit(False)))
        return acc & good

    return F.aggregate(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))),
                       F.lit(True), ok)
