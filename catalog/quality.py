"""Checks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom import types as tt
from tapeloom.operators import dedup as dd
from tapeloom.operators import joins as jn
from tapeloom.operators import quality as qa
from tapeloom.sources.feeds import FEEDS
from tapeloom.sources.grid import expand
from tapeloom.sources.views import Views


@query("q_natural_key", """
    SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate' AS problem FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q_natural_key(v: Views):
    return qa.natural_key_violations(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q_business_date", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS raw_date FROM orders WHERE CAST(o_orderdate AS DATE) <> CAST(date_trunc('month', o_orderdate) AS DATE)""")
def q_business_date(v: Views):
    """Asset date is the first of the month, so all later days disagree."""
    rows = v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("raw_date"),
                                    F.to_date(F.date_trunc("month", "o_orderdate")).alias("asset_date"))
    return qa.wrong_business_date(rows, "raw_date", F.col("asset_date")).select("o_orderkey", "raw_date")


@query("q_distinct_dates", "SELECT l_orderkey, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates FROM lineitem GROUP BY l_orderkey")
def q_distinct_dates(v: Views):
    return qa.distinct_dates(v.table("lineitem").withColumn("d", F.to_date("l_shipdate")), ["l_orderkey"], "d")


@query("q_truncation", """
    WITH caps AS (SELECT endpoint, max(n) AS row_cap FROM (SELECT endpoint, CAST(requested_at AS DATE) AS d, count(*) AS n FROM v_req GROUP BY ALL) GROUP BY endpoint)
    SELECT endpoint, d, n, row_cap, n >= row_cap AS truncated FROM (SELECT endpoint, CAST(requested_at AS DATE) AS d, count(*) AS n FROM v_req GROUP BY ALL) JOIN caps USING (endpoint)""")
def q_truncation(v: Views):
    """Cap of an endpoint: its largest day, so at least one scope per endpoint is suspect."""
    daily = v.req.withColumn("d", F.to_date("requested_at"))
    caps = daily.groupBy("endpoint", "d").agg(F.count("*").alias("n")).groupBy("endpoint").agg(F.max("n").alias("row_cap"))
    return qa.truncation_suspects(daily, ["endpoint", "d"], caps)


@query("q_calendar_complete", """
    SELECT exchange, CAST(y AS INTEGER) AS year, n_days, CAST(dayofyear(make_date(y, 12, 31)) AS INTEGER) AS expected, n_days = dayofyear(make_date(y, 12, 31)) AS complete
    FROM (SELECT o_orderpriority AS exchange, year(o_orderdate) AS y, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY ALL)""")
def q_calendar_complete(v: Views):
    cal = v.table("orders").select(F.col("o_orderpriority").alias("exchange"), F.to_date("o_orderdate").alias("cal_date"))
    return qa.calendar_completeness(cal)


@query("q_missing_exchange", "SELECT unnest(['SSE', 'SZSE']) AS exchange")
def q_missing_exchange(v: Views):
    return qa.missing_exchanges(v.cal, ["ASIA", "EUROPE", "SSE", "SZSE"])


@query("q_empty_scopes", """
    WITH grid AS (SELECT d AS trade_date, code, policy FROM (SELECT DISTINCT trade_date AS d FROM v_bars), (SELECT DISTINCT code FROM v_sec),
                  (SELECT unnest(['ALLOWED', 'RETRY', 'UNSUPPORTED', 'FORBIDDEN']) AS policy)),
    n AS (SELECT code, trade_date, count(*) AS n FROM v_flow GROUP BY ALL)
    SELECT policy, outcome, count(*) AS scopes FROM (
      SELECT policy, CASE WHEN n.n > 0 THEN 'DATA' WHEN policy = 'ALLOWED' THEN 'EMPTY_VALID' WHEN policy = 'UNSUPPORTED' THEN 'SKIPPED' WHEN policy = 'FORBIDDEN' THEN 'FAILED'
             WHEN trade_date < DATE '2024-01-20' THEN 'GAP' ELSE 'RETRY' END AS outcome FROM grid LEFT JOIN n USING (code, trade_date)) GROUP BY ALL""")
def q_empty_scopes(v: Views):
    days = v.bars.agg(F.array_sort(F.collect_set("trade_date"))).scalar()
    grid = expand(v.sec.select("code").withColumn("_days", days), trade_date=F.col("_days"),
                  policy=["ALLOWED", "RETRY", "UNSUPPORTED", "FORBIDDEN"]).drop("_days")
    counts = v.flow.groupBy("code", "trade_date").agg(F.count("*").alias("n"))
    out = qa.classify_empty(grid, counts, ["code", "trade_date"], policy=F.col("policy"), day="trade_date",
                            today=F.lit("2024-04-20").cast("date"), retention_months=F.lit(FEEDS["dc_concept"].retention_months),
                            exhausted=F.lit(False))
    return out.groupBy("policy", "outcome").agg(F.count("*").alias("scopes"))


@query("q_ohlc", """
    WITH shifted AS (SELECT code, trade_date, open, high, CASE WHEN volume = 1 THEN low + 1 ELSE low END AS low, close FROM v_bars)
    SELECT code, trade_date FROM shifted WHERE least(open, high, low, close) <= 0 OR low > least(open, close) OR high < greatest(open, close)""")
def q_ohlc(v: Views):
    shifted = v.bars.withColumn("low", F.when(F.col("volume") == 1, (F.col("low") + 1).cast(tt.PRICE)).otherwise(F.col("low")))
    return qa.ohlc_violations(shifted).select("code", "trade_date")


@query("q_anomaly_gate", """
    WITH t AS (SELECT trade_date, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS valid, count(*) FILTER (WHERE bad) AS issues FROM (
        SELECT trade_date, close < 1.5 AS bad FROM v_bars) GROUP BY trade_date)
    SELECT trade_date, total, valid, issues, issues AS reported, CAST(least(20, greatest(1, total // 100)) AS BIGINT) AS allowed,
           issues = 0 OR (valid > 0 AND issues <= least(20, greatest(1, total // 100))) AS passed FROM t""")
def q_anomaly_gate(v: Views):
    return qa.anomaly_gate(v.bars, ["trade_date"], F.col("close") < 1.5)


@query("q_segment_lag", """
    WITH j AS (SELECT p.trade_date, p.close, p.pre_close, CASE WHEN s.exchange = 'ASIA' THEN p.pre_close ELSE p.close END AS other
               FROM v_px p JOIN v_sec s USING (code) WHERE s.exchange IN ('ASIA', 'EUROPE')),
    c AS (SELECT trade_date, count(*) FILTER (WHERE pre_close IS NOT NULL) AS comparable,
          count(*) FILTER (WHERE pre_close IS NOT NULL AND abs(other - pre_close) <= 0.001) AS matches,
          count(*) FILTER (WHERE pre_close IS NOT NULL AND abs(close - pre_close) > 0.001) AS changed,
          count(*) FILTER (WHERE pre_close IS NOT NULL AND abs(close - pre_close) > 0.001 AND abs(other - pre_close) <= 0.001) AS changed_matches
          FROM j WHERE other IS NOT NULL GROUP BY trade_date)
    SELECT *, coalesce(comparable >= 20 AND changed_matches >= 20 AND matches * 100 >= comparable * 95 AND changed_matches * 100 >= changed * 95, false) AS lagging FROM c""")
def q_segment_lag(v: Views):
    """One exchange repeats the previous close; the verdict depends on its share of the segment."""
    joined = v.px.join(v.sec, "code").withColumn("other", F.when(F.col("exchange") == "ASIA", F.col("pre_close")).otherwise(F.col("close")))
    return qa.segment_lag(joined, ["trade_date"], F.col("exchange").isin("ASIA", "EUROPE"), close="close", pre_close="pre_close", other_close="other")


@query("q_row_accounting", """
    SELECT trade_date, count(*) AS rows_read, count(*) FILTER (WHERE pre_close IS NULL) AS rows_rejected, count(*) FILTER (WHERE pre_close IS NOT NULL) AS rows_written
    FROM v_px GROUP BY trade_date""")
def q_row_accounting(v: Views):
    tagged = v.px.withColumn("reason", F.when(F.col("pre_close").isNull(), "pre_close missing"))
    return qa.row_accounting(tagged, ["trade_date"], "reason")


@query("q_examples", """
    WITH d AS (SELECT DISTINCT trade_date, code FROM v_suspend)
    SELECT trade_date, n, examples FROM (SELECT trade_date, count(*) AS n FROM d GROUP BY ALL)
    JOIN (SELECT trade_date, string_agg(code, ',' ORDER BY code) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY code) AS rn FROM d)
          WHERE rn <= 5 GROUP BY ALL) USING (trade_date)""")
def q_examples(v: Views):
    return jn.examples_per_key(v.suspend, ["trade_date"], "code", 5)


@query("q_snapshot_unique", """
    SELECT trade_date, slot, 'code' AS kind, code AS value, count(*) AS n FROM v_hot GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT trade_date, slot, 'rank', CAST(rank AS VARCHAR), count(*) FROM v_hot GROUP BY ALL HAVING count(*) > 1""")
def q_snapshot_unique(v: Views):
    return dd.snapshot_duplicates(v.hot, ["trade_date", "slot"], "code", "rank")
