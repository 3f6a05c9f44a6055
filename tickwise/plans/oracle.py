"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement runs on the driver's pre-registered views (``lineitem``,
``customer``, ``orders``, ``events`` ...). The fixture tables of
``tickwise.sources.testdata`` are re-derived here as CTEs with the same
rules, so both engines start from identical rows. Column names and types
match the Spark side; floating results that are not bit-exact between the
engines are rounded to 4 decimals on both sides (SURVEY §5.3).
"""

from __future__ import annotations

# --- fixture CTEs -------------------------------------------------------------

BARS = """
bars AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
         CAST(l_shipdate AS DATE) AS date,
         arg_min(floor(l_extendedprice), (l_orderkey, l_linenumber, l_partkey)) AS open,
         max(floor(l_extendedprice)) AS high,
         min(floor(l_extendedprice)) AS low,
         arg_max(floor(l_extendedprice), (l_orderkey, l_linenumber, l_partkey)) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem
  GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""

USERS = """
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS username,
         lower(c_name) || '@example.com' AS email,
         c_custkey % 10 <> 0 AS is_active,
         CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'premium' END AS tier
  FROM customer
)"""

API_KEYS = """
api_keys AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         'key_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key,
         CAST(o_custkey AS BIGINT) AS user_id,
         o_orderstatus <> 'P' AS is_active,
         o_orderdate AS created_at
  FROM orders
)"""

REQUESTS = """
requests AS (
  SELECT event_id AS request_id, ts, user_id,
         'S' || CAST(event_id % ((SELECT count(*) FROM supplier) + 3) AS VARCHAR) AS symbol,
         CASE event_type WHEN 'view' THEN 'sma' WHEN 'click' THEN 'ema'
              WHEN 'purchase' THEN 'rsi' WHEN 'signup' THEN 'macd'
              WHEN 'error' THEN 'bollinger' END AS indicator,
         CAST(DATE '1996-01-01' + CAST(event_id % 1000 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '1996-01-01' + CAST(event_id % 1000 AS INTEGER) + 365 AS DATE) AS end_date
  FROM events
)"""

REQUEST_LOG = """
request_log AS (
  SELECT event_id AS id, user_id, event_type AS endpoint, 'GET' AS method,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         CAST(floor(value) AS INTEGER) AS response_time,
         ts AS timestamp
  FROM events
)"""

# Tier policy as literal rows (fixed values, see tickwise.operators.policy).
POLICY = """
tier_policy AS (
  SELECT * FROM (VALUES
    ('free', 0, 50, 90, 'sma,ema'),
    ('pro', 1, 500, 365, 'sma,ema,rsi,macd'),
    ('premium', 2, NULL, NULL, 'sma,ema,rsi,macd,bollinger')
  ) AS t(tier, tier_rank, requests_per_day, data_limit_days, allowed)
)"""

# Quota tests use small limits so the daily counts (at most ~11) hit them.
TEST_POLICY = """
tier_policy AS (
  SELECT * FROM (VALUES
    ('free', 0, 2, 90, 'sma,ema'),
    ('pro', 1, 5, 365, 'sma,ema,rsi,macd'),
    ('premium', 2, NULL, NULL, 'sma,ema,rsi,macd,bollinger')
  ) AS t(tier, tier_rank, requests_per_day, data_limit_days, allowed)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    SQL[name] = text.strip()


# --- scans, filters, statistics -----------------------------------------------

sql("bars_scan", with_(BARS) + """
SELECT symbol, date, open, high, low, close, volume FROM bars""")

sql("bars_date_norm", """
SELECT l_orderkey, l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
       CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice) AS close
FROM lineitem""")

sql("bars_sorted", with_(BARS) + """
SELECT count(*) AS records, false AS out_of_order FROM bars""")

sql("series_by_symbol", with_(BARS) + """
SELECT symbol, date, open, high, low, close, volume FROM bars WHERE symbol = 'S1'""")

sql("series_range", with_(BARS) + """
SELECT symbol, date, open, high, low, close, volume FROM bars
WHERE symbol = 'S1' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")

sql("unknown_symbols", with_(BARS) + """
SELECT event_id AS request_id, 'S' || CAST(user_id AS VARCHAR) AS symbol
FROM events
WHERE 'S' || CAST(user_id AS VARCHAR) NOT IN (SELECT symbol FROM bars)""")

sql("symbols_distinct", with_(BARS) + """
SELECT DISTINCT symbol FROM bars""")

sql("symbols_first_n", with_(BARS) + """
SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 20""")

sql("date_range", with_(BARS) + """
SELECT min(date) AS start_date, max(date) AS end_date FROM bars""")

sql("dataset_info", with_(BARS) + """
SELECT true AS loaded, count(DISTINCT symbol) AS symbols, count(*) AS records,
       min(date) AS start_date, max(date) AS end_date FROM bars""")

sql("symbol_profile", with_(BARS) + """
SELECT symbol, count(*) AS records, min(date) AS start_date, max(date) AS end_date,
       min(low) AS min_low, max(high) AS max_high, avg(close) AS avg_close,
       CAST(sum(volume) AS BIGINT) AS total_volume
FROM bars GROUP BY symbol""")

_PROFILED = (("symbol", "string"), ("date", "date"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "bigint"))
sql("dataset_profile", with_(BARS) + " UNION ALL ".join(
    f"""
SELECT {n} AS position, '{c}' AS "column", '{kind}' AS type, count(*) AS records, count(*) - count({c}) AS nulls,
       CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM bars""" for n, (c, kind) in enumerate(_PROFILED, 1)))

sql("date_range_stored", with_(BARS) + """
SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS records FROM bars""")

# --- window kernels -------------------------------------------------------------

_W = "PARTITION BY symbol ORDER BY date"


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


sql("rolling_mean", with_(BARS) + f"""
SELECT symbol, date, avg(close) OVER {_frame(20)} AS rolling_mean FROM bars""")

sql("rolling_std", with_(BARS) + f"""
SELECT symbol, date, round(stddev_samp(close) OVER {_frame(20)}, 4) AS rolling_std FROM bars""")

sql("close_diff", with_(BARS) + f"""
SELECT symbol, date, close - lag(close) OVER ({_W}) AS close_diff FROM bars""")

sql("gain_loss", with_(BARS) + f"""
SELECT symbol, date,
       CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain,
       CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss
FROM (SELECT symbol, date, close - lag(close) OVER ({_W}) AS d FROM bars)""")


def _ewm_recursive(source_cte: str, keys: str, value: str, spans: dict[str, int],
                   macd: tuple[int, int, int] | None = None) -> str:
    """Recursive CTE stepping row_number over all series at once.

    ``spans`` maps an output name to a span (exponential means of ``value``);
    ``macd`` adds fast/slow/signal columns ``m_fast, m_slow, m_signal``.
    """
    seeds, steps = [], []
    for out, span in spans.items():
        a = 2.0 / (span + 1.0)
        seeds.append(f"s.{value} AS {out}")
        steps.append(f"{a!r} * s.{value} + {1.0 - a!r} * e.{out} AS {out}")
    if macd:
        fa, sa, ga = (2.0 / (p + 1.0) for p in macd)
        seeds += [f"s.{value} AS m_fast", f"s.{value} AS m_slow", "CAST(0.0 AS DOUBLE) AS m_signal"]
        nf = f"({fa!r} * s.{value} + {1.0 - fa!r} * e.m_fast)"
        ns = f"({sa!r} * s.{value} + {1.0 - sa!r} * e.m_slow)"
        steps += [f"{nf} AS m_fast", f"{ns} AS m_slow",
                  f"{ga!r} * ({nf} - {ns}) + {1.0 - ga!r} * e.m_signal AS m_signal"]
    key_list = [k.strip() for k in keys.split(",")]
    join = " AND ".join(f"s.{k} = e.{k}" for k in key_list)
    key_sel = ", ".join(f"s.{k}" for k in key_list)
    return f"""
seq AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS rn FROM {source_cte}),
ewm AS (
  SELECT {key_sel}, s.date, s.rn, {", ".join(seeds)}
  FROM seq s WHERE s.rn = 1
  UNION ALL
  SELECT {key_sel}, s.date, s.rn, {", ".join(steps)}
  FROM ewm e JOIN seq s ON {join} AND s.rn = e.rn + 1
)"""


sql("ewm_mean", with_recursive(BARS, _ewm_recursive("bars", "symbol", "high", {"ewm_mean": 10})) + """
SELECT symbol, date, round(ewm_mean, 4) AS ewm_mean FROM ewm""")

# --- indicators -----------------------------------------------------------------

sql("sma", with_(BARS) + f"""
SELECT symbol, date, avg(close) OVER {_frame(20)} AS sma FROM bars""")

sql("ema", with_recursive(BARS, _ewm_recursive("bars", "symbol", "close", {"ema": 20})) + """
SELECT symbol, date, round(ema, 4) AS ema FROM ewm""")


def _rsi_sql(source: str, keys: str, period: int, extra: str = "") -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""
rsi_d AS (SELECT *, close - lag(close) OVER ({w}) AS d FROM {source}),
rsi_a AS (
  SELECT *,
    avg(CASE WHEN d > 0 THEN d ELSE 0.0 END) OVER ({w} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS ag,
    avg(CASE WHEN d < 0 THEN -d ELSE 0.0 END) OVER ({w} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS al
  FROM rsi_d),
rsi AS (
  SELECT *, CASE WHEN al > 0 THEN 100.0 - 100.0 / (1.0 + ag / al) WHEN ag > 0 THEN 100.0 END AS rsi
  FROM rsi_a)"""


sql("rsi", with_(BARS, _rsi_sql("bars", "symbol", 14)) + """
SELECT symbol, date, rsi FROM rsi""")

sql("macd", with_recursive(BARS, _ewm_recursive("bars", "symbol", "close", {}, (12, 26, 9))) + """
SELECT symbol, date, round(m_fast - m_slow, 4) AS macd, round(m_signal, 4) AS signal,
       round(m_fast - m_slow - m_signal, 4) AS histogram FROM ewm""")

sql("bollinger", with_(BARS) + f"""
SELECT symbol, date,
       round(avg(close) OVER {_frame(20)} + stddev_samp(close) OVER {_frame(20)} * 2.0, 4) AS upper,
       avg(close) OVER {_frame(20)} AS middle,
       round(avg(close) OVER {_frame(20)} - stddev_samp(close) OVER {_frame(20)} * 2.0, 4) AS lower
FROM bars""")

SUITE_CTES = (BARS, _ewm_recursive("bars", "symbol", "close", {"ema": 20}, (12, 26, 9)),
              _rsi_sql("bars", "symbol", 14))
SUITE_SELECT = f"""
suite AS (
  SELECT r.symbol, r.date, r.close,
         avg(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')} AS sma,
         e.ema, r.rsi,
         e.m_fast - e.m_slow AS macd, e.m_signal AS macd_signal,
         e.m_fast - e.m_slow - e.m_signal AS macd_histogram,
         avg(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')}
           + 2.0 * stddev_samp(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')} AS bb_upper,
         avg(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')} AS bb_middle,
         avg(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')}
           - 2.0 * stddev_samp(r.close) OVER {_frame(20).replace('symbol', 'r.symbol').replace('date', 'r.date')} AS bb_lower
  FROM rsi r JOIN ewm e ON r.symbol = e.symbol AND r.date = e.date
)"""

sql("indicator_suite", with_recursive(*SUITE_CTES, SUITE_SELECT) + """
SELECT symbol, date, sma, round(ema, 4) AS ema, rsi, round(macd, 4) AS macd,
       round(macd_signal, 4) AS macd_signal, round(macd_histogram, 4) AS macd_histogram,
       round(bb_upper, 4) AS bb_upper, bb_middle, round(bb_lower, 4) AS bb_lower
FROM suite""")

SQL["sma_stored"] = SQL["sma"]
SQL["suite_stored"] = SQL["indicator_suite"]
SQL["suite_appended"] = SQL["indicator_suite"] + " WHERE date >= DATE '1998-01-01'"

# --- output shaping -------------------------------------------------------------------

sql("sma_trimmed", with_(BARS) + f"""
SELECT symbol, date, sma FROM (
  SELECT symbol, date, avg(close) OVER {_frame(20)} AS sma,
         row_number() OVER ({_W}) AS pos FROM bars) WHERE pos > 19""")

sql("rsi_trimmed", with_(BARS, _rsi_sql("bars", "symbol", 14)) + f"""
SELECT symbol, date, rsi FROM (SELECT symbol, date, rsi, row_number() OVER ({_W}) AS pos FROM rsi)
WHERE pos > 14""")

sql("macd_trimmed", with_recursive(BARS, _ewm_recursive("bars", "symbol", "close", {}, (12, 26, 9))) + """
SELECT symbol, date, round(coalesce(m_fast - m_slow, 0.0), 4) AS macd,
       round(coalesce(m_signal, 0.0), 4) AS signal,
       round(coalesce(m_fast - m_slow - m_signal, 0.0), 4) AS histogram
FROM ewm WHERE rn > 25""")

sql("bollinger_filled", with_(BARS) + f"""
SELECT symbol, date, round(coalesce(upper, 0.0), 4) AS upper, coalesce(middle, 0.0) AS middle,
       round(coalesce(lower, 0.0), 4) AS lower FROM (
  SELECT symbol, date,
         avg(close) OVER {_frame(20)} + stddev_samp(close) OVER {_frame(20)} * 2.0 AS upper,
         avg(close) OVER {_frame(20)} AS middle,
         avg(close) OVER {_frame(20)} - stddev_samp(close) OVER {_frame(20)} * 2.0 AS lower,
         row_number() OVER ({_W}) AS pos
  FROM bars) WHERE pos > 19""")

sql("suite_long", with_recursive(*SUITE_CTES, SUITE_SELECT) + """
SELECT symbol, date, indicator, round(value, 4) AS value
FROM suite UNPIVOT INCLUDE NULLS (value FOR indicator IN
  (sma, ema, rsi, macd, macd_signal, macd_histogram, bb_upper, bb_middle, bb_lower))""")

sql("bollinger_period_one_filled", with_(BARS) + """
SELECT symbol, date, 0.0::DOUBLE AS upper, close AS middle, 0.0::DOUBLE AS lower FROM bars""")

sql("bollinger_untrimmed_filled", with_(BARS) + f"""
SELECT symbol, date,
       round(coalesce(avg(close) OVER {_frame(20)} + stddev_samp(close) OVER {_frame(20)} * 2.0, 0.0), 4) AS upper,
       avg(close) OVER {_frame(20)} AS middle,
       round(coalesce(avg(close) OVER {_frame(20)} - stddev_samp(close) OVER {_frame(20)} * 2.0, 0.0), 4) AS lower
FROM bars""")

# --- policy ----------------------------------------------------------------------------------

sql("tier_entitlements", with_(USERS, POLICY) + """
SELECT u.id, u.tier, p.tier_rank, p.requests_per_day, p.data_limit_days, p.allowed
FROM users u JOIN tier_policy p
  ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END""")

sql("indicator_entitlement", with_(USERS, REQUESTS, POLICY) + f"""
SELECT r.request_id, u.tier, r.indicator,
       list_contains(string_split(p.allowed, ','), lower(r.indicator)) AS entitled
FROM requests r LEFT JOIN users u ON u.id = r.user_id
LEFT JOIN tier_policy p ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END""")

sql("tier_gate", with_(USERS, REQUESTS) + f"""
SELECT r.request_id, u.tier, r.indicator,
       (CASE u.tier WHEN 'free' THEN 0 WHEN 'pro' THEN 1 WHEN 'premium' THEN 2 ELSE 0 END)
         >= (CASE lower(r.indicator) WHEN 'sma' THEN 0 WHEN 'ema' THEN 0 WHEN 'rsi' THEN 1
             WHEN 'macd' THEN 1 WHEN 'bollinger' THEN 2 ELSE 0 END) AS gate_ok
FROM requests r LEFT JOIN users u ON u.id = r.user_id""")

sql("default_range", with_(REQUESTS) + """
SELECT request_id,
       coalesce(CASE WHEN request_id % 4 IN (0, 1) THEN NULL ELSE start_date END,
                CAST(coalesce(CASE WHEN request_id % 4 IN (0, 2) THEN NULL ELSE end_date END,
                              DATE '1999-01-01') - 365 AS DATE)) AS start_date,
       coalesce(CASE WHEN request_id % 4 IN (0, 2) THEN NULL ELSE end_date END,
                DATE '1999-01-01') AS end_date
FROM requests""")

_LIMITED = """
limited AS (
  SELECT r.*, u.tier, u.is_active AS user_active, p.tier_rank, p.requests_per_day AS daily_limit,
         p.data_limit_days
  FROM requests r LEFT JOIN users u ON u.id = r.user_id
  LEFT JOIN tier_policy p
    ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END
)"""

_GREATEST3 = ("CASE WHEN {a} >= coalesce({b}, {a}) AND {a} >= {c} THEN {a} "
              "WHEN coalesce({b}, {c}) >= {c} THEN coalesce({b}, {c}) ELSE {c} END")

sql("clamp_range", with_(BARS, USERS, REQUESTS, POLICY, _LIMITED) + f"""
SELECT request_id, tier,
       CAST({_GREATEST3.format(a="start_date", b="DATE '1999-01-01' - data_limit_days",
                               c="(SELECT min(date) FROM bars)")} AS DATE) AS eff_start,
       least(end_date, (SELECT max(date) FROM bars)) AS eff_end
FROM limited""")

sql("reject_range", with_(USERS, REQUESTS, POLICY, _LIMITED) + """
SELECT request_id, tier,
       CASE WHEN s > e THEN 400
            WHEN data_limit_days IS NOT NULL AND s < DATE '1997-06-01' - data_limit_days THEN 403
            ELSE 200 END AS status_code
FROM (SELECT *, CASE WHEN request_id % 7 = 0 THEN end_date ELSE start_date END AS s,
                CASE WHEN request_id % 7 = 0 THEN start_date ELSE end_date END AS e FROM limited)""")

sql("param_bounds", with_(REQUESTS) + """
SELECT request_id, indicator, ok AS params_ok, CASE WHEN ok THEN 200 ELSE 422 END AS status_code
FROM (SELECT request_id, indicator,
        CASE indicator
          WHEN 'sma' THEN n BETWEEN 1 AND 200
          WHEN 'ema' THEN n BETWEEN 1 AND 200
          WHEN 'rsi' THEN n BETWEEN 1 AND 100
          WHEN 'macd' THEN n BETWEEN 1 AND 100 AND request_id % 230 BETWEEN 1 AND 200
          ELSE n BETWEEN 1 AND 200 AND (request_id % 61) / 10.0 BETWEEN 0.1 AND 5.0
        END AS ok
      FROM (SELECT *, request_id % 250 AS n FROM requests))""")

sql("param_bounds_alternate", with_(REQUESTS) + """
SELECT request_id, indicator,
       CASE indicator
         WHEN 'sma' THEN n BETWEEN 1 AND 200
         WHEN 'ema' THEN n BETWEEN 1 AND 200
         WHEN 'rsi' THEN n BETWEEN 1 AND 100
         WHEN 'macd' THEN n BETWEEN 1 AND 50 AND request_id % 230 BETWEEN 1 AND 200
         ELSE n BETWEEN 1 AND 200 AND (request_id % 61) / 10.0 BETWEEN 0.1 AND 5.0
       END AS params_ok
FROM (SELECT *, request_id % 250 AS n FROM requests)""")

# --- quotas ------------------------------------------------------------------------------------

sql("quota_decision", with_(USERS, REQUESTS, TEST_POLICY, _LIMITED) + """
SELECT request_id, user_id, day,
       daily_limit IS NULL OR rk <= daily_limit AS allowed,
       CASE WHEN daily_limit IS NULL THEN 0 WHEN rk <= daily_limit THEN rk - 1 ELSE daily_limit END
         AS used,
       CASE WHEN daily_limit IS NULL THEN NULL WHEN rk <= daily_limit THEN daily_limit - rk + 1
            ELSE 0 END AS remaining,
       CASE WHEN daily_limit IS NOT NULL AND rk > daily_limit THEN CAST(day + 1 AS DATE) END
         AS reset_date
FROM (SELECT *, CAST(ts AS DATE) AS day,
             CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id)
                  AS INTEGER) AS rk
      FROM limited)""")

sql("quota_remaining_shared", with_(USERS, REQUESTS, TEST_POLICY, _LIMITED) + """
SELECT request_id, CASE WHEN daily_limit IS NULL THEN 999999 ELSE greatest(daily_limit - rk + 1, 0) END AS remaining
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS INTEGER) AS rk FROM limited)""")

sql("quota_usage", with_(USERS, REQUESTS, TEST_POLICY) + """
SELECT user_id, day, tier, daily_limit, used,
       CASE WHEN daily_limit IS NOT NULL THEN greatest(daily_limit - used, 0) END AS remaining,
       CASE WHEN daily_limit IS NOT NULL AND used >= daily_limit THEN CAST(day + 1 AS DATE) END
         AS reset_date
FROM (SELECT c.user_id, c.day, u.tier, p.requests_per_day AS daily_limit,
             CASE WHEN p.requests_per_day IS NULL THEN 0
                  ELSE least(CAST(c.n AS INTEGER), p.requests_per_day) END AS used
      FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM requests GROUP BY 1, 2) c
      LEFT JOIN users u ON u.id = c.user_id
      LEFT JOIN tier_policy p
        ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END)""")

_CONSUMED = """
consumed AS (
  SELECT c.user_id, c.day, least(c.n, p.requests_per_day) AS requests, c.first_ts, p.requests_per_day AS daily_limit
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS first_ts FROM requests GROUP BY 1, 2) c
  LEFT JOIN users u ON u.id = c.user_id
  LEFT JOIN tier_policy p ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END
)"""

sql("quota_counters", with_(USERS, REQUESTS, TEST_POLICY, _CONSUMED) + """
SELECT user_id, day, requests FROM consumed WHERE requests > 0""")

sql("quota_retention", with_(USERS, REQUESTS, TEST_POLICY, _CONSUMED) + """
SELECT user_id, day, requests FROM consumed
WHERE first_ts >= TIMESTAMP '2024-01-29 12:00:00' AND requests > 0""")

# --- identity -------------------------------------------------------------------------------------

sql("resolve_keys", with_(USERS, API_KEYS) + """
SELECT request_id, api_key, reason,
       CASE WHEN reason = 'ok' THEN key_user END AS user_id,
       CASE WHEN reason = 'ok' THEN 200 ELSE 401 END AS status_code
FROM (
  SELECT p.request_id, p.api_key, k.user_id AS key_user,
         CASE WHEN NOT (starts_with(p.api_key, 'key_') AND length(p.api_key) > 10) THEN 'invalid_format'
              WHEN k.user_id IS NULL THEN 'invalid_key'
              WHEN u.is_active IS NULL OR NOT u.is_active THEN 'user_inactive'
              ELSE 'ok' END AS reason
  FROM (SELECT event_id AS request_id,
               CASE WHEN event_id % 10 = 0 THEN 'tok_' || CAST(event_id AS VARCHAR)
                    WHEN event_id % 10 = 1 THEN 'key_' || lpad(CAST(event_id + 1000000000 AS VARCHAR), 10, '0')
                    ELSE 'key_' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS api_key
        FROM events) p
  LEFT JOIN (SELECT key, user_id FROM api_keys WHERE is_active) k
    ON k.key = p.api_key AND starts_with(p.api_key, 'key_') AND length(p.api_key) > 10
  LEFT JOIN users u ON u.id = k.user_id)""")

sql("key_listing", with_(API_KEYS) + """
SELECT user_id, id, substring(key, 1, 10) || '...' AS key_hint, is_active FROM api_keys""")

sql("key_revocations", with_(API_KEYS) + """
SELECT event_id, CASE WHEN k.id IS NULL THEN 404 ELSE 200 END AS status_code
FROM events e LEFT JOIN api_keys k ON k.id = e.event_id AND k.user_id = e.user_id""")

sql("keys_after_revocations", with_(API_KEYS) + """
SELECT id, user_id, is_active AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = id AND e.user_id = k.user_id) AS is_active FROM api_keys k""")

# Of valid candidates that share a name the first is accepted, unless it is refused itself: settled in order.
sql("intake_conflicts", "WITH RECURSIVE " + USERS + r""",
candidates AS (
  SELECT candidate_id, username, email, tier,
         CASE WHEN NOT (length(username) BETWEEN 3 AND 50) THEN 'invalid_username'
              WHEN NOT regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$') THEN 'invalid_email'
              WHEN username IN (SELECT username FROM users) OR email IN (SELECT email FROM users) THEN 'conflict' END AS status
  FROM (SELECT event_id AS candidate_id,
        CASE WHEN event_id % 3 = 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
             WHEN event_id % 5 = 0 THEN 'u' || CAST(event_id % 10 AS VARCHAR)
             WHEN event_id % 4 = 1 THEN 'twin_' || CAST(event_id % 90 AS VARCHAR)
             ELSE 'new_user_' || CAST(event_id AS VARCHAR) END AS username,
        CASE WHEN event_id % 3 = 1 THEN 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com'
             WHEN event_id % 7 = 0 THEN 'not-an-email'
             WHEN event_id % 4 <> 3 THEN 'twin' || CAST(event_id % 70 AS VARCHAR) || '@example.com'
             ELSE 'new' || CAST(event_id AS VARCHAR) || '@example.com' END AS email,
        CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'pro' END AS tier
      FROM events WHERE event_type = 'signup')),
open AS (SELECT *, row_number() OVER (ORDER BY candidate_id) AS n FROM candidates WHERE status IS NULL),
taken AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS names, []::BIGINT[] AS ok
  UNION ALL
  SELECT o.n, CASE WHEN list_has_any(t.names, ['u' || o.username, 'e' || o.email]) THEN t.names ELSE t.names || ['u' || o.username, 'e' || o.email] END,
         CASE WHEN list_has_any(t.names, ['u' || o.username, 'e' || o.email]) THEN t.ok ELSE t.ok || [o.candidate_id] END
  FROM taken t JOIN open o ON o.n = t.n + 1),
accepted AS (SELECT unnest(ok) AS candidate_id FROM taken WHERE n = (SELECT max(n) FROM taken))
SELECT c.candidate_id, username, email,
       coalesce(status, CASE WHEN a.candidate_id IS NULL THEN 'conflict' ELSE 'ok' END) AS status,
       CASE WHEN tier IN ('free', 'pro', 'premium') THEN tier ELSE 'free' END AS tier
FROM candidates c LEFT JOIN accepted a USING (candidate_id)""")

# --- materialised results ------------------------------------------------------------------------

_CACHE = """
cache AS (
  SELECT request_id, ts AS cached_at,
         'indicator:' || symbol || ':' || upper(indicator) || ':' ||
         CASE indicator
           WHEN 'sma' THEN 'end_date:' || CAST(end_date AS VARCHAR) || '_start_date:' || CAST(start_date AS VARCHAR) || '_window:20'
           WHEN 'ema' THEN 'end_date:' || CAST(end_date AS VARCHAR) || '_start_date:' || CAST(start_date AS VARCHAR) || '_window:20'
           WHEN 'rsi' THEN 'end_date:' || CAST(end_date AS VARCHAR) || '_period:14_start_date:' || CAST(start_date AS VARCHAR)
           WHEN 'macd' THEN 'end_date:' || CAST(end_date AS VARCHAR) || '_fast_period:12_signal_period:9_slow_period:26_start_date:' || CAST(start_date AS VARCHAR)
           ELSE 'end_date:' || CAST(end_date AS VARCHAR) || '_period:20_start_date:' || CAST(start_date AS VARCHAR) || '_std_dev:2.0'
         END AS params_key
  FROM requests
)"""

sql("params_key", with_(REQUESTS, _CACHE) + """
SELECT request_id, params_key FROM cache""")

sql("fresh_results", with_(REQUESTS, _CACHE) + """
SELECT params_key, arg_max(request_id, (cached_at, request_id)) AS request_id
FROM cache
WHERE cached_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1440 MINUTE
  AND cached_at <= TIMESTAMP '2024-01-30 00:00:00'
GROUP BY params_key""")

sql("invalidate_matches", with_(REQUESTS, _CACHE) + """
SELECT params_key, request_id FROM cache WHERE params_key GLOB 'indicator:S1:*'""")

sql("results_read_through", with_(REQUESTS, _CACHE) + """
SELECT params_key, live.value IS NOT NULL AS hit, coalesce(live.value, -1) AS value
FROM (SELECT DISTINCT params_key FROM cache WHERE request_id % 3 = 0) asked
LEFT JOIN (SELECT params_key, arg_max(request_id, (cached_at, request_id)) AS value FROM cache
           WHERE request_id % 3 <> 0 AND cached_at > TIMESTAMP '2024-01-10 00:00:00'
             AND cached_at <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY params_key) live USING (params_key)""")

sql("cache_hits", with_(REQUESTS, _CACHE) + """
SELECT lower(split_part(params_key, ':', 3)) AS indicator, count(*) AS requests, count(live.k) AS hits, count(*) - count(live.k) AS misses
FROM cache LEFT JOIN (SELECT DISTINCT params_key AS k FROM cache WHERE request_id % 3 <> 0 AND cached_at > TIMESTAMP '2024-01-10 00:00:00'
                        AND cached_at <= TIMESTAMP '2024-01-30 00:00:00') live ON live.k = params_key
WHERE request_id % 3 = 0 GROUP BY 1""")

sql("store_after_invalidation", with_(REQUESTS, _CACHE) + """
SELECT request_id, params_key, lower(split_part(params_key, ':', 3)) AS indicator,
       CASE WHEN request_id % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS cached_on
FROM cache WHERE request_id % 2 = 1 OR NOT params_key GLOB 'indicator:S?:[SE]MA:*'""")

sql("store_lookup", with_(REQUESTS, _CACHE) + """
SELECT request_id, params_key FROM cache
WHERE params_key GLOB 'indicator:S1:*' AND (request_id % 2 = 1 OR NOT params_key GLOB 'indicator:S?:[SE]MA:*')""")

sql("invalidate_count", with_(REQUESTS, _CACHE) + """
SELECT count(DISTINCT params_key) AS deleted FROM cache WHERE params_key GLOB 'indicator:S[1-3]:*'""")

sql("invalidate_rest", with_(REQUESTS, _CACHE) + """
SELECT params_key, request_id FROM cache WHERE NOT params_key GLOB 'indicator:S?:[SE]MA:*'""")

# --- request tables -------------------------------------------------------------------------------

# Requests of every kind (sources.testdata.requests_mixed), with their parameters as columns.
MIXED = """
mixed AS (
  SELECT request_id, ts, user_id, symbol, CASE WHEN request_id % 97 = 0 THEN 'vwap' ELSE indicator END AS indicator, indicator AS swept,
         CASE WHEN request_id % 10 = 0 THEN 'tok_' || CAST(request_id AS VARCHAR)
              WHEN request_id % 10 = 5 THEN 'key_' || lpad(CAST(request_id AS VARCHAR), 10, '0') END AS api_key,
         CASE WHEN request_id % 4 IN (0, 1) THEN NULL ELSE start_date END AS start_date,
         CASE WHEN request_id % 4 IN (0, 2) THEN NULL ELSE end_date END AS end_date,
         CAST(request_id % 250 AS INTEGER) AS p1, CAST(request_id % 230 AS INTEGER) AS p2, 9 AS p3, (request_id % 61) / 10.0 AS k
  FROM requests
)"""

STATUS = """
acting AS (
  SELECT m.* EXCLUDE (user_id), CASE WHEN m.api_key IS NULL THEN m.user_id ELSE a.user_id END AS user_id
  FROM mixed m LEFT JOIN (SELECT key, user_id FROM api_keys WHERE is_active) a
    ON a.key = m.api_key AND starts_with(m.api_key, 'key_') AND length(m.api_key) > 10
), gated AS (
  SELECT r.*, u.tier, p.requests_per_day AS daily_limit, p.data_limit_days,
         CASE WHEN indicator = 'vwap' THEN 'unknown_indicator'
              WHEN NOT coalesce(u.is_active, false) THEN 'unauthenticated'
              WHEN NOT list_contains(string_split(p.allowed, ','), indicator) THEN 'tier'
              WHEN NOT CASE indicator WHEN 'sma' THEN p1 BETWEEN 1 AND 200 WHEN 'ema' THEN p1 BETWEEN 1 AND 200
                   WHEN 'rsi' THEN p1 BETWEEN 1 AND 100 WHEN 'macd' THEN p1 BETWEEN 1 AND 100 AND p2 BETWEEN 1 AND 200
                   ELSE p1 BETWEEN 1 AND 200 AND k BETWEEN 0.1 AND 5.0 END THEN 'bounds' END AS gate
  FROM acting r LEFT JOIN users u ON u.id = r.user_id
  LEFT JOIN tier_policy p ON p.tier = CASE WHEN u.tier IN ('free', 'pro', 'premium') THEN u.tier ELSE 'free' END
), ranked AS (
  SELECT g.*, q.rk FROM gated g LEFT JOIN (
    SELECT request_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id) AS rk
    FROM gated WHERE gate IS NULL) q USING (request_id)
), ranged AS (
  SELECT *, coalesce(end_date, DATE '1999-01-01') AS e0,
         coalesce(start_date, CAST(coalesce(end_date, DATE '1999-01-01') - 365 AS DATE)) AS s0
  FROM ranked
), clamped AS (
  SELECT *,
    coalesce(gate, CASE WHEN daily_limit IS NOT NULL AND rk > daily_limit THEN 'quota' END) AS stopped,
    CAST(CASE WHEN data_limit_days IS NULL THEN greatest(s0, (SELECT min(date) FROM bars))
              ELSE greatest(s0, DATE '1999-01-01' - data_limit_days, (SELECT min(date) FROM bars)) END AS DATE) AS eff_start,
    least(e0, (SELECT max(date) FROM bars)) AS eff_end,
    symbol IN (SELECT DISTINCT symbol FROM bars) AS known
  FROM ranged
), counted AS (
  SELECT c.request_id, count(*) AS points
  FROM clamped c JOIN bars b ON b.symbol = c.symbol AND b.date BETWEEN c.eff_start AND c.eff_end
  WHERE c.stopped IS NULL
  GROUP BY c.request_id
), status AS (
  SELECT c.*, coalesce(n.points, 0) AS points,
         coalesce(stopped, CASE WHEN NOT known THEN 'unknown_symbol' WHEN coalesce(n.points, 0) = 0 THEN 'empty_range' ELSE 'ok' END) AS reason
  FROM clamped c LEFT JOIN counted n USING (request_id)
)"""

_STATUS_CTES = (BARS, USERS, API_KEYS, REQUESTS, TEST_POLICY, MIXED, STATUS)

sql("batch_request_status", with_(*_STATUS_CTES) + """
SELECT request_id, CASE reason WHEN 'unauthenticated' THEN 401 WHEN 'tier' THEN 403 WHEN 'bounds' THEN 422
                               WHEN 'quota' THEN 429 WHEN 'ok' THEN 200 ELSE 404 END AS status_code,
       reason, eff_start, eff_end, CASE WHEN reason = 'ok' THEN points ELSE 0 END AS points
FROM status""")

# Points of accepted requests (rounded as catalog.r4), each with its own parameters (frames and steps take them from the row).
EVALUATED = """
pts AS (
  SELECT r.request_id, r.indicator, r.p1, r.p2, r.p3, r.k, b.date, b.close,
         CASE WHEN r.indicator IN ('ema', 'macd') THEN 2.0::DOUBLE / (r.p1 + 1) ELSE 1 END AS a1,
         CASE WHEN r.indicator = 'macd' THEN 2.0::DOUBLE / (r.p2 + 1) ELSE 1 END AS a2,
         2.0::DOUBLE / (r.p3 + 1) AS a3
  FROM status r JOIN bars b ON b.symbol = r.symbol AND b.date BETWEEN r.eff_start AND r.eff_end
  WHERE r.reason = 'ok'),
seq AS (
  SELECT *, row_number() OVER w AS rn, coalesce(close - lag(close) OVER w, 0.0) AS d
  FROM pts WINDOW w AS (PARTITION BY request_id ORDER BY date)),
ewm AS (
  SELECT request_id, rn, close AS f, close AS s, CAST(0.0 AS DOUBLE) AS g FROM seq WHERE rn = 1 AND indicator IN ('ema', 'macd')
  UNION ALL
  SELECT s.request_id, s.rn, a1 * close + (1 - a1) * e.f, a2 * close + (1 - a2) * e.s,
         a3 * ((a1 * close + (1 - a1) * e.f) - (a2 * close + (1 - a2) * e.s)) + (1 - a3) * e.g
  FROM ewm e JOIN seq s ON s.request_id = e.request_id AND s.rn = e.rn + 1),
rolled AS (
  SELECT *, avg(close) OVER w AS mean, stddev_samp(close) OVER w AS sd,
         sum(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS up, sum(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS down
  FROM seq WINDOW w AS (PARTITION BY request_id ORDER BY date ROWS BETWEEN (p1 - 1) PRECEDING AND CURRENT ROW)),
evaluated AS (
  SELECT r.request_id, r.date,
         round(CASE indicator WHEN 'sma' THEN mean WHEN 'ema' THEN f
               WHEN 'rsi' THEN CASE WHEN down > 0 THEN 100.0 - 100.0 / (1.0 + up / down) WHEN up > 0 THEN 100.0 END END, 4) AS value,
         CASE WHEN indicator = 'macd' THEN round(f - s, 4) END AS macd, CASE WHEN indicator = 'macd' THEN round(g, 4) END AS signal,
         CASE WHEN indicator = 'macd' THEN round(f - s - g, 4) END AS histogram,
         CASE WHEN indicator = 'bollinger' THEN round(mean + k::DOUBLE * sd, 4) END AS upper,
         CASE WHEN indicator = 'bollinger' THEN round(mean, 4) END AS middle,
         CASE WHEN indicator = 'bollinger' THEN round(mean - k::DOUBLE * sd, 4) END AS lower
  FROM rolled r LEFT JOIN ewm e ON e.request_id = r.request_id AND e.rn = r.rn)"""

sql("batch_evaluate", with_recursive(*_STATUS_CTES, EVALUATED) + """
SELECT request_id, date, value, macd, signal, histogram, upper, middle, lower FROM evaluated""")


def _documents(indicator: str, title: str, columns: tuple[str, ...], parameters: str) -> str:
    line = " || '|' || ".join(["CAST(e.date AS VARCHAR)"] + [f"CASE WHEN e.{c} IS NULL THEN 'null' ELSE format('{{:.4f}}', e.{c} + 0.0) END" for c in columns])
    return with_recursive(*_STATUS_CTES, EVALUATED) + f"""
SELECT s.request_id, s.symbol, '{title}' AS indicator, {parameters} AS parameters, count(*) AS data_points,
       s.eff_start AS start_date, s.eff_end AS end_date, md5(string_agg({line} || ';', '' ORDER BY e.date)) AS data_md5
FROM status s JOIN evaluated e USING (request_id) WHERE s.indicator = '{indicator}'
GROUP BY ALL"""


sql("indicator_documents", _documents("sma", "SMA", ("value",), "'window=' || format('{:.1f}', s.p1::DOUBLE)"))
sql("macd_documents", _documents("macd", "MACD", ("macd", "signal", "histogram"),
                                 "'fast_period=' || format('{:.1f}', s.p1::DOUBLE) || ',signal_period=9.0,slow_period=' || format('{:.1f}', s.p2::DOUBLE)"))
sql("bollinger_documents", _documents("bollinger", "Bollinger Bands", ("upper", "middle", "lower"),
                                      "'period=' || format('{:.1f}', s.p1::DOUBLE) || ',std_dev=' || format('{:.1f}', s.k::DOUBLE)"))


def _batch_points(indicator: str) -> str:
    return f"""
pts AS (
  SELECT r.request_id, b.date, b.close
  FROM requests r JOIN bars b ON b.symbol = r.symbol AND b.date BETWEEN r.start_date AND r.end_date
  WHERE r.indicator = '{indicator}'
)"""


_RW = "PARTITION BY request_id ORDER BY date"


def _rframe(n: int) -> str:
    return f"({_RW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


sql("batch_sma", with_(BARS, REQUESTS, _batch_points("sma")) + f"""
SELECT request_id, date, avg(close) OVER {_rframe(20)} AS sma FROM pts""")

sql("batch_ema", with_recursive(BARS, REQUESTS, _batch_points("ema"),
                                _ewm_recursive("pts", "request_id", "close", {"ema": 20})) + """
SELECT request_id, date, round(ema, 4) AS ema FROM ewm""")

sql("batch_rsi", with_(BARS, REQUESTS, _batch_points("rsi"), _rsi_sql("pts", "request_id", 14)) + """
SELECT request_id, date, round(rsi, 4) AS rsi FROM rsi""")

sql("batch_macd", with_recursive(BARS, REQUESTS, _batch_points("macd"),
                                 _ewm_recursive("pts", "request_id", "close", {}, (12, 26, 9))) + """
SELECT request_id, date, round(m_fast - m_slow, 4) AS macd, round(m_signal, 4) AS signal,
       round(m_fast - m_slow - m_signal, 4) AS histogram FROM ewm""")

sql("batch_bollinger", with_(BARS, REQUESTS, _batch_points("bollinger")) + f"""
SELECT request_id, date,
       round(avg(close) OVER {_rframe(20)} + stddev_samp(close) OVER {_rframe(20)} * 2.0, 4) AS upper,
       avg(close) OVER {_rframe(20)} AS middle,
       round(avg(close) OVER {_rframe(20)} - stddev_samp(close) OVER {_rframe(20)} * 2.0, 4) AS lower
FROM pts""")

sql("request_log_rollup", with_(REQUEST_LOG) + """
SELECT endpoint, CAST(timestamp AS DATE) AS day, count(*) AS requests,
       avg(response_time) AS avg_ms,
       round(quantile_cont(response_time, 0.5), 4) AS p50_ms,
       round(quantile_cont(response_time, 0.95), 4) AS p95_ms,
       avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) AS error_ratio
FROM request_log GROUP BY endpoint, CAST(timestamp AS DATE)""")

sql("request_log_rollup_approx", with_(REQUEST_LOG) + """
SELECT endpoint, CAST(timestamp AS DATE) AS day, count(*) AS requests,
       CAST(quantile_disc(response_time, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(response_time, 0.95) AS DOUBLE) AS p95_ms
FROM request_log GROUP BY endpoint, CAST(timestamp AS DATE)""")

sql("request_log_rollup_weekly", with_(REQUEST_LOG) + """
SELECT endpoint, CAST(date_trunc('week', timestamp) AS DATE) AS period, count(*) AS requests, avg(response_time) AS avg_ms,
       CAST(quantile_disc(response_time, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(response_time, 0.95) AS DOUBLE) AS p95_ms,
       avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) AS error_ratio
FROM request_log GROUP BY 1, 2""")

# --- streaming ----------

sql("stream_quota_counts", with_(USERS, REQUESTS, TEST_POLICY, _CONSUMED) + """
SELECT user_id, day, requests FROM consumed WHERE daily_limit > 0""")

SQL["stream_quota_decision"] = SQL["quota_decision"]
