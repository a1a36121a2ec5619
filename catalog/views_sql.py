"""DuckDB definitions of the market-shaped views, independent of the Spark code."""

VIEWS = {
    "v_ticks": """
        SELECT event_id, ts, 'U' || user_id AS code, CAST(ts AS DATE) AS trade_date, event_type,
               CAST(value AS DECIMAL(20,6)) AS value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "v_bars": """
        SELECT code, trade_date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, event_id) AS close, count(*) AS volume, CAST(sum(value) AS DECIMAL(24,4)) AS amount
        FROM v_ticks GROUP BY code, trade_date""",
    "v_px": """
        SELECT *, CAST(close - pre_close AS DECIMAL(20,6)) AS change,
               CAST(CAST(close - pre_close AS DOUBLE) / CAST(pre_close AS DOUBLE) * 100 AS DECIMAL(14,6)) AS pct_chg
        FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close FROM v_bars)""",
    "v_tech": """
        SELECT code, trade_date, CAST(open * 0.5 AS DECIMAL(20,6)) AS open_qfq, CAST(high * 0.5 AS DECIMAL(20,6)) AS high_qfq,
               CAST(low * 0.5 AS DECIMAL(20,6)) AS low_qfq, CAST(close * 0.5 AS DECIMAL(20,6)) AS close_qfq,
               CAST(pre_close * 0.5 AS DECIMAL(20,6)) AS pre_close_qfq,
               CAST(high - low AS DECIMAL(20,6)) AS macd, close AS source_close
        FROM v_px WHERE volume >= 2""",
    "v_flow": """
        SELECT code, trade_date, CAST(sum(CASE event_type WHEN 'purchase' THEN value ELSE -value END) AS DECIMAL(24,4)) AS net_mf_amount,
               count(*) FILTER (WHERE event_type = 'purchase') AS net_mf_vol
        FROM v_ticks WHERE event_type IN ('purchase', 'error') GROUP BY code, trade_date""",
    "v_suspend": """
        SELECT code, trade_date, CASE WHEN arg_max(value, event_id) >= 50 THEN 'S' ELSE 'R' END AS suspend_type
        FROM v_ticks WHERE event_type = 'error' GROUP BY code, trade_date""",
    "v_sec": """
        SELECT 'U' || c_custkey AS code, c_name AS name, c_mktsegment AS industry, r_name AS exchange, n_name AS area,
               CASE WHEN c_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_aliases": "SELECT code AS old_code, 'N' || substr(code, 2) AS new_code FROM v_sec WHERE list_status = 'D'",
    "v_topics": """
        SELECT 'T' || s_suppkey AS topic, s_name AS topic_name, CASE WHEN s_acctbal < 0 THEN 'TH' ELSE 'N' END AS kind
        FROM supplier""",
    "v_mem": """
        SELECT 'T' || e.l_suppkey AS topic, 'P' || e.l_partkey AS member,
               round(CAST(e.qty AS DOUBLE) * 100 / CAST(t.total AS DOUBLE), 6) AS weight
        FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY ALL) e
        JOIN (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY ALL) t USING (l_suppkey)""",
    "v_parts": "SELECT 'P' || p_partkey AS member, p_name AS name, p_brand AS industry, p_type AS kind FROM part",
    "v_hot": """
        SELECT trade_date, event_id, code, k AS rank, value AS score, CAST(floor(hour(ts) / 6) AS INTEGER) AS slot, event_type, ts AS captured
        FROM v_ticks""",
    "v_cal": """
        SELECT r_name AS exchange, CAST(d AS DATE) AS cal_date, isodow(d) <= 5 AS is_open
        FROM region, (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM events)""",
    "v_rel": """
        SELECT event_type AS dataset, trade_date, count(*) AS row_count, max(ts) AS published_at, max(event_id) AS version
        FROM v_ticks GROUP BY event_type, trade_date HAVING arg_max(k, event_id) >= 20""",
    "v_release_log": """
        SELECT event_type AS dataset, trade_date, CAST(floor(hour(ts) / 6) AS INTEGER) AS slot, count(*) AS row_count,
               max(ts) AS published_at, max(event_id) AS version
        FROM v_ticks GROUP BY ALL""",
    "v_req": """
        SELECT event_id AS request_id, 'ep_' || event_type AS endpoint, ts AS requested_at,
               CASE WHEN k < 10 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
               CAST(trunc(value * 10) AS BIGINT) AS duration_ms,
               CASE WHEN k > 80 THEN k ELSE 0 END AS wait_ms, CASE WHEN k = 50 THEN 0 ELSE k END AS row_count
        FROM v_ticks""",
    "v_bat": """
        SELECT o_orderkey AS batch_id, o_orderdate AS scheduled_at,
               CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS batch_status,
               CAST(o_orderdate AS DATE) AS business_date, o_orderpriority AS batch_type
        FROM orders""",
    "v_tsk": """
        SELECT l_orderkey AS batch_id, 'api' || l_linenumber AS task_name, 'part=' || l_partkey AS scope_key,
               CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'N' THEN 'FAILED' ELSE 'RETRY_WAIT' END AS status,
               l_shipdate AS finished_at
        FROM lineitem""",
    "v_proc": """
        SELECT o_orderkey AS process_id, o_orderpriority AS task_name, CAST(date_trunc('week', o_orderdate) AS DATE) AS business_date,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'QUEUED' END AS status,
               o_orderdate AS queued_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at,
               CASE WHEN o_totalprice > 400000 THEN 0 ELSE 1 END AS priority
        FROM orders""",
    "v_dep": """
        SELECT l_orderkey AS process_id, 'api' || l_linenumber AS name, 'part=' || l_partkey AS scope,
               CASE l_returnflag WHEN 'A' THEN 'READY' WHEN 'N' THEN 'WAITING' ELSE 'MISSING' END AS status,
               CASE WHEN l_returnflag = 'R' THEN 'no asset for ' || l_partkey END AS blocked_reason
        FROM lineitem""",
    "v_jobs": """
        SELECT event_id AS execution_id, 'job_' || code AS job_id,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
               ts AS created_at, k
        FROM v_ticks""",
}
