"""Latest-row, top-k, window and paging queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import query
from tapeloom.operators import ranking as rk
from tapeloom.sources.views import Views


@query("w_latest_per_key", """
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, execution_id DESC) AS newest FROM v_jobs)
    SELECT job_id, execution_id, status FROM ranked WHERE newest = 1""")
def w_latest_per_key(v: Views):
    newest = rk.latest_per_key(v.jobs, ["job_id"], [F.col("created_at").desc(), F.col("execution_id").desc()])
    return newest.select("job_id", "execution_id", "status")


@query("w_keep_first", """
    SELECT job_id, execution_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, execution_id) = 1 AS is_first
    FROM v_jobs WHERE status = 'RUNNING'""")
def w_keep_first(v: Views):
    pending = v.jobs.where("status = 'RUNNING'")
    return rk.mark_first(pending, ["job_id"], F.struct("created_at", "execution_id")).select("job_id", "execution_id", "is_first")


@query("w_analytic_surface", """
    SELECT code, trade_date, row_number() OVER w AS rn, rank() OVER (PARTITION BY code ORDER BY volume DESC) AS rk,
           dense_rank() OVER (PARTITION BY code ORDER BY volume DESC) AS dr, CAST(lag(close) OVER w AS DOUBLE) AS lag_close,
           CAST(lead(close) OVER w AS DOUBLE) AS lead_close, CAST(first_value(open) OVER w AS DOUBLE) AS first_open,
           CAST(last_value(close) OVER w AS DOUBLE) AS last_close
    FROM v_bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)""")
def w_analytic_surface(v: Views):
    """Default frames; a code has at most one bar per day, which bounds every partition."""
    by_day, by_volume = Window.partitionBy("code").orderBy("trade_date"), Window.partitionBy("code").orderBy(F.col("volume").desc())
    return v.bars.select(
        "code", "trade_date", F.row_number().over(by_day).cast("long").alias("rn"), F.rank().over(by_volume).cast("long").alias("rk"),
        F.dense_rank().over(by_volume).cast("long").alias("dr"), F.lag("close").over(by_day).alias("lag_close"),
        F.lead("close").over(by_day).alias("lead_close"), F.first_value("open").over(by_day).alias("first_open"),
        F.last_value("close").over(by_day).alias("last_close"))


@query("w_freshest", """
    WITH i AS (SELECT process_id, count(*) AS n, max(scope) AS input_at FROM v_dep WHERE status = 'READY' GROUP BY process_id),
    r AS (SELECT p.*, i.input_at, row_number() OVER (PARTITION BY task_name, business_date
            ORDER BY i.input_at IS NOT NULL DESC, i.input_at DESC NULLS LAST, p.queued_at DESC, p.process_id DESC) AS rn FROM v_proc p LEFT JOIN i USING (process_id))
    SELECT task_name, business_date, process_id, input_at FROM r WHERE rn = 1""")
def w_freshest(v: Views):
    inputs = v.dep.where("status = 'READY'").select("process_id", "scope")
    return rk.freshest(v.proc, inputs, ["task_name", "business_date"], "process_id", input_time="scope", candidate_time="queued_at")


@query("page_total", """
    SELECT dataset, trade_date, slot, row_count, (SELECT count(*) FROM v_release_log) AS total
    FROM v_release_log ORDER BY trade_date DESC, dataset, slot LIMIT 40 OFFSET 60""")
def page_total(v: Views):
    rows = v.release_log.select("dataset", "trade_date", "slot", "row_count")
    return rk.page(rows, [F.col("trade_date").desc(), F.col("dataset").asc(), F.col("slot").asc()], 60, 40)


@query("w_group_representative", """
    SELECT job_id, count(*) AS n, max(execution_id) AS execution_id, arg_max(k, execution_id) AS k FROM v_jobs GROUP BY job_id""")
def w_group_representative(v: Views):
    return rk.representative(v.jobs, ["job_id"], -F.col("execution_id"), ["execution_id", "k"], "n")
