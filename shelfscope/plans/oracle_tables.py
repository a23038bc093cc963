"""SQL text of the stand-in tables, for the independent check of every registered query."""

from __future__ import annotations

TABLES = {
    "lines": """
        SELECT l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS full_date,
               CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sales,
               CAST(l_quantity AS BIGINT) AS customers,
               CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS promo,
               l_returnflag AS state_holiday,
               CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS school_holiday,
               CASE WHEN l_quantity > 2 THEN 1 ELSE 0 END AS open
        FROM lineitem""",
    "fact": """
        SELECT store_id, full_date, CAST(ROUND(SUM(sales), 2) AS DECIMAL(14,2)) AS sales,
               CAST(SUM(customers) AS BIGINT) AS customers, MAX(promo) AS promo,
               MAX(state_holiday) AS state_holiday, MAX(school_holiday) AS school_holiday, MAX(open) AS open,
               year(full_date) * 10000 + month(full_date) * 100 + day(full_date) AS date_id
        FROM lines GROUP BY store_id, full_date""",
    "dim_store": """
        SELECT s_suppkey AS store_id, n_name AS store_type, substr('abc', s_nationkey % 3 + 1, 1) AS assortment,
               CAST(abs(s_acctbal) AS DECIMAL(12,2)) AS competition_distance, s_suppkey % 2 AS promo2
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "dim_date": """
        SELECT year(d) * 10000 + month(d) * 100 + day(d) AS date_id, CAST(d AS DATE) AS full_date
        FROM (SELECT unnest(generate_series(
            (SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem),
            (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem), INTERVAL 1 DAY)) AS d)""",
    "run_log": """
        SELECT event_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'store' END AS source_name,
               ts AS created_at, CASE WHEN event_type = 'view' THEN 'report_only' ELSE 'enforce' END AS mode,
               CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'WARN' ELSE 'PASS' END AS final_status,
               value > 200 AS blocked, value > 50 AS used_unified, user_id % 20 AS data_source_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "rule_log": """
        SELECT run_id, source_name, created_at, 'rule_' || (k + o) % 7 AS rule_id,
               CASE WHEN (k + o) % 7 % 2 = 0 THEN 'between' ELSE 'accepted_values' END AS rule_type,
               CASE WHEN (k + o) % 7 < 4 THEN 'FAIL' ELSE 'WARN' END AS severity,
               CASE WHEN o = 0 THEN final_status WHEN k % 5 = 0 THEN 'WARN' ELSE 'PASS' END AS status,
               'rule_' || (k + o) % 7 || ' violated' AS message, k
        FROM run_log, (VALUES (0), (3)) AS t(o) WHERE k % 4 < 3""",
    "data_sources": """
        SELECT n_nationkey AS id, n_name AS name, n_nationkey = 7 AS is_default, n_regionkey <> 3 AS is_active
        FROM nation""",
    "attempts": """
        SELECT event_id AS attempt_id, 'channel_' || user_id % 5 AS channel_target,
               CASE WHEN event_id % 2 = 0 THEN 'ALERT_FIRING' ELSE 'ALERT_RESOLVED' END AS event_type,
               user_id % 13 AS alert_id, st AS attempt_status, ts AS started_at,
               ts + to_milliseconds(COALESCE(dur, 0)) AS completed_at, dur AS duration_ms,
               CASE WHEN st <> 'SENT' THEN CASE k % 5 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'NETWORK_ERROR'
                    ELSE 'HTTP_ERROR' END END AS error_code,
               CASE WHEN event_id % 11 = 0 THEN 'n' || event_id END AS replayed_from_id, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     CASE WHEN event_type IN ('purchase', 'view') THEN 'SENT' WHEN event_type = 'click' THEN 'RETRY'
                          WHEN event_type = 'error' THEN 'DEAD' ELSE 'FAILED' END AS st,
                     CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 17 <> 0
                          THEN CAST(round(value * 100) AS INTEGER) END AS dur
              FROM events)""",
    "outbox": """
        SELECT event_id AS id, 'evt_' || event_id AS event_id, 'channel_' || user_id % 7 AS channel_target,
               CASE WHEN event_id % 2 = 0 THEN 'ALERT_FIRING' ELSE 'ALERT_RESOLVED' END AS event_type,
               CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'signup' THEN 'RETRYING' WHEN 'error' THEN 'DEAD'
                    WHEN 'view' THEN 'FAILED' ELSE 'SENT' END AS status,
               k % 6 AS attempt_count, 5 AS max_attempts, ts + to_minutes(k) AS next_retry_at, ts AS created_at,
               CASE WHEN event_id % 11 = 0 THEN 'n' || event_id END AS replayed_from_id, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "messages": """
        SELECT conv_id, turn, CASE (conv_id + turn) % 9
                 WHEN 0 THEN 'Forecast store ' || conv_id || ' for 45 days. '
                 WHEN 1 THEN 'KPI from 2001-03-05 to 2001-01-02. '
                 WHEN 2 THEN 'Compare store #' || conv_id || ' vs store 3. '
                 WHEN 3 THEN 'top stores until 2000-06-30 '
                 WHEN 4 THEN 'promo for store_id ' || conv_id || ', 999 days '
                 WHEN 5 THEN 'توقع المتجر 12 '
                 WHEN 6 THEN 'model accuracy? '
                 WHEN 7 THEN 'pipeline data status '
                 ELSE '' END || COALESCE(text, '') AS message
        FROM conversations""",
    "raw_sales": """
        SELECT CASE WHEN l_quantity = 13 AND l_linenumber = 7 THEN 'A' ELSE CAST(l_suppkey AS VARCHAR) END AS store,
               CASE WHEN l_quantity = 11 THEN 'x' WHEN l_quantity = 7 AND l_linenumber = 6 THEN '9'
                    ELSE CAST(isodow(l_shipdate) AS VARCHAR) END AS day_of_week,
               CASE WHEN l_quantity = 17 AND l_linenumber = 3 THEN 'not-a-date'
                    WHEN l_linenumber % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
                    WHEN l_linenumber % 4 = 1 THEN strftime(l_shipdate, '%m/%d/%Y')
                    WHEN l_linenumber % 4 = 2 THEN strftime(l_shipdate, '%Y/%m/%d')
                    ELSE strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d 00:00:00') END AS full_date,
               CASE WHEN l_quantity = 23 AND l_linenumber = 2 THEN NULL
                    WHEN l_quantity = 19 AND l_linenumber = 1 THEN 'abc'
                    WHEN l_quantity = 29 AND l_linenumber = 5 THEN '-50'
                    ELSE ' ' || l_extendedprice || ' ' END AS sales,
               CASE WHEN l_discount >= 0.015 THEN CAST(l_quantity AS VARCHAR) END AS customers,
               CASE WHEN l_linenumber = 7 THEN 'yes' WHEN l_quantity > 2 THEN '1' ELSE '0' END AS open,
               CASE WHEN l_discount >= 0.05 THEN '1.0' ELSE '0' END AS promo,
               ' ' || l_returnflag || ' ' AS state_holiday,
               CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS school_holiday,
               CAST(l_partkey AS VARCHAR) AS custom_metric
        FROM lineitem""",
    "unified": """
        SELECT TRY_CAST(store AS BIGINT) AS store_id, TRY_CAST(day_of_week AS BIGINT) AS day_of_week,
               CAST(COALESCE(try_strptime(full_date, '%Y-%m-%d'), try_strptime(full_date, '%Y-%m-%d %H:%M:%S'),
                             try_strptime(full_date, '%Y/%m/%d'), try_strptime(full_date, '%m/%d/%Y')) AS DATE)
                 AS full_date,
               TRY_CAST(trim(sales) AS DOUBLE) AS sales, TRY_CAST(customers AS DOUBLE) AS customers,
               CAST(TRY_CAST(open AS DOUBLE) AS BIGINT) AS open, CAST(TRY_CAST(promo AS DOUBLE) AS BIGINT) AS promo,
               trim(state_holiday) AS state_holiday, TRY_CAST(school_holiday AS BIGINT) AS school_holiday,
               custom_metric, store AS raw_store, day_of_week AS raw_day, full_date AS raw_date, sales AS raw_sales,
               customers AS raw_customers, open AS raw_open
        FROM raw_sales""",
    "raw_store": """
        SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS store_type,
               CASE WHEN s_suppkey % 9 <> 0 THEN substr('abc', s_suppkey % 3 + 1, 1) END AS assortment,
               CASE WHEN s_suppkey % 11 <> 3 AND s_suppkey % 5 <> 0
                    THEN CAST(abs(s_acctbal) AS DECIMAL(12,2)) END AS competition_distance,
               CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 12 + 1 END AS open_month,
               CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 20 + 1995 END AS open_year,
               CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 2 END AS promo2,
               CASE WHEN s_suppkey % 6 = 1 THEN s_suppkey % 53 END AS promo2_week,
               CASE WHEN s_suppkey % 6 = 1 THEN s_suppkey % 20 + 1995 END AS promo2_year,
               CASE WHEN s_suppkey % 6 = 1 THEN 'Jan,Apr,Jul,Oct' END AS promo_interval
        FROM supplier""",
    "silences": """
        SELECT o_orderkey AS silence_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'policy_' || o_orderkey % 10 END AS policy_id,
               CASE o_orderkey % 4 WHEN 1 THEN 'train' WHEN 2 THEN 'store' END AS source_name,
               CASE o_orderkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS severity,
               CASE WHEN o_orderkey % 2 = 0 THEN 'rule_' || o_orderkey % 3 END AS rule_id,
               o_orderdate AS created_at, o_orderdate AS starts_at,
               o_orderdate + to_days(CAST(o_custkey % 30 + 1 AS INTEGER)) AS ends_at,
               CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 5 DAY END AS expired_at
        FROM orders""",
    "alert_items": """
        SELECT event_id AS alert_id, 'policy_' || k % 10 AS policy_id,
               CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'store' END AS source_name,
               CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CASE WHEN k % 4 <> 0 THEN 'rule_' || k % 3 END AS rule_id,
               CASE WHEN value > 40 THEN 'FIRING' ELSE 'PENDING' END AS status, ts AS last_seen_at, user_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "results": """
        SELECT event_id AS id, k % 5 = 0 AS success,
               CASE k % 5 WHEN 0 THEN 204 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 400 END AS http_status,
               CASE k % 5 WHEN 0 THEN NULL WHEN 4 THEN 'NETWORK_ERROR' ELSE 'HTTP_ERROR' END AS error_code,
               CASE WHEN k % 5 <> 0 THEN 'call failed  code ' || k % 5 END AS error
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 10 <> 9""",
    "snapshots": """
        SELECT event_type, seen_at, CAST(SUM(n) OVER (PARTITION BY event_type, CAST(seen_at AS DATE) ORDER BY seen_at) AS BIGINT) AS value
        FROM (SELECT event_type, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS seen_at, COUNT(*) AS n
              FROM events GROUP BY 1, 2)""",
}
NEEDS = {"unified": ("raw_sales",), "fact": ("lines",), "rule_log": ("run_log",)}


def oracle(tables: str, body: str) -> str:
    """``body`` behind the named stand-in tables, those they need first; further CTEs may open ``body``."""
    ordered: list[str] = []
    for name in tables.split():
        for part in (*NEEDS.get(name, ()), name):
            if part not in ordered:
                ordered.append(part)
    head = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
