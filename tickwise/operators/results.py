"""Materialised indicator results.

The service caches whole responses under a derived key with a TTL. Here the
cache is a table with ``params_key`` and ``cached_at`` columns: writes append,
fresh reads filter on age and keep the newest entry per key, invalidation is a
selection. ``materialise`` appends to a plain folder; ``operators.store`` keeps
the table in whole versions, with deletion and key lookup.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL_MINUTES = 30  # fixed value of the service


def params_key(symbol: Column, indicator: Column, params: Column,
               start: Column | None = None, end: Column | None = None) -> Column:
    """``indicator:{symbol}:{NAME}:{k:v joined by _, keys sorted}``.
    Dates (after clamping) are parameters; user and tier are not."""
    p = params
    if start is not None and end is not None:
        dates = F.create_map(F.lit("start_date"), F.date_format(start, "yyyy-MM-dd"),
                             F.lit("end_date"), F.date_format(end, "yyyy-MM-dd"))
        p = F.map_concat(params, dates)
    pairs = F.transform(F.array_sort(F.map_entries(p)),
                        lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat(F.lit("indicator:"), symbol, F.lit(":"), F.upper(indicator), F.lit(":"),
                    F.array_join(pairs, "_"))


def materialise(results: DataFrame, path: str, cached_at, mode: str = "append") -> None:
    """Append results with their write time, partitioned by indicator."""
    (results.withColumn("cached_at", F.lit(cached_at).cast("timestamp"))
            .write.mode(mode).partitionBy("indicator").parquet(path))


def read_through(asked: DataFrame, entries: DataFrame, compute, as_of, ttl_minutes: int = DEFAULT_TTL_MINUTES,
                 key_col: str = "params_key", value_cols=("value",), order=("cached_at",)) -> DataFrame:
    """Probe, compute the misses, return all: every key of ``asked`` with its
    fresh entry, or with what ``compute`` makes of the asked rows without one;
    ``hit`` tells which. Store the rows without a hit by ``materialise``."""
    live = newest_per_key(fresh(entries, as_of, ttl_minutes), value_cols, key_col, order=order).select(key_col, *value_cols)
    asked = asked.dropDuplicates([key_col])
    hits = asked.select(key_col).join(live, key_col)
    misses = asked.join(live.select(key_col), key_col, "left_anti")
    made = compute(misses).select(key_col, *value_cols)
    return hits.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False)))


def hit_counts(asked: DataFrame, entries: DataFrame, as_of, ttl_minutes: int = DEFAULT_TTL_MINUTES,
               key_col: str = "params_key") -> DataFrame:
    """Hits and misses of a table of requests, per indicator (the third part
    of the key): every request counts, fresh entries answer it. Requests are
    counted by key first, so a hot key is one row in the join."""
    live = fresh(entries, as_of, ttl_minutes).select(key_col).distinct().withColumn("__hit", F.lit(1))
    by_key = asked.groupBy(key_col).agg(F.count(F.lit(1)).alias("__n")).join(live, key_col, "left")
    hits = F.coalesce(F.sum(F.when(F.col("__hit") == 1, F.col("__n"))), F.lit(0))
    return (by_key.groupBy(F.lower(F.split_part(F.col(key_col), F.lit(":"), F.lit(3))).alias("indicator"))
            .agg(F.sum("__n").alias("requests"), hits.alias("hits"), (F.sum("__n") - hits).alias("misses")))


def fresh(entries: DataFrame, as_of, ttl_minutes: int = DEFAULT_TTL_MINUTES,
          key_col: str = "params_key", ts_col: str = "cached_at") -> DataFrame:
    """Entries younger than the TTL at ``as_of`` (0 means the default)."""
    ttl = ttl_minutes or DEFAULT_TTL_MINUTES
    now = F.lit(as_of).cast("timestamp")
    return entries.where((F.col(ts_col) > now - F.make_interval(mins=F.lit(ttl)))
                         & (F.col(ts_col) <= now))


def newest_per_key(entries: DataFrame, value_cols, key_col: str = "params_key",
                   ts_col: str = "cached_at", order=None) -> DataFrame:
    """The latest write per key (``max_by`` is a partial aggregate, so a hot
    key is combined map-side). ``order``: columns, ``ts_col`` first, that tell
    apart writes of the same time; by default the values themselves do."""
    by = F.struct(*[F.col(c) for c in dict.fromkeys([ts_col, *(order or value_cols)])])
    latest = F.max_by(F.struct(*[F.col(c) for c in value_cols]), by)
    return (entries.groupBy(key_col)
                   .agg(F.max(ts_col).alias(ts_col), latest.alias("__v"))
                   .select(key_col, ts_col, *[F.col("__v")[c].alias(c) for c in value_cols]))


def glob_to_regex(pattern: str) -> str:
    """Key-pattern glob (``*``, ``?``, ``[...]``, backslash escapes) as an
    anchored regular expression."""
    out, i, n = ["^"], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = pattern.find("]", i + 1)
            body = pattern[i + 1:j] if j != -1 else ""
            if not body or body == "^":  # nothing to choose from: the bracket itself
                out.append(re.escape(ch))
            else:
                negated = body.startswith("^")
                # Inside brackets only ranges are special; Java would read [ and && as set operations.
                chosen = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in body[negated:])
                out.append("[" + "^" * negated + chosen + "]")
                i = j + 1
                continue
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def literal_prefix(pattern: str) -> str:
    """What every key that matches the glob starts with."""
    return re.match(r"[^*?\[\\]*", pattern).group()


def key_matches(pattern: str, key_col: str) -> Column:
    prefix = literal_prefix(pattern)  # reaches the scan; a regular expression doesn't
    matched = F.col(key_col).rlike(glob_to_regex(pattern))
    return F.col(key_col).startswith(prefix) & matched if prefix else matched


def matching(entries: DataFrame, pattern: str, key_col: str = "params_key") -> DataFrame:
    """O52 selection: entries whose key matches the glob."""
    return entries.where(key_matches(pattern, key_col))


def invalidate(entries: DataFrame, pattern: str, key_col: str = "params_key") -> DataFrame:
    """What remains after deleting the matching keys (a null key matches nothing)."""
    return entries.where(~F.coalesce(key_matches(pattern, key_col), F.lit(False)))
