"""Operations read models and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.operators import lineage as ln
from tapeloom.operators.ranking import page
from tapeloom.plans import operations as ops
from tapeloom.sources.views import Views

SCOPE = ["task_name", "business_date"]
DATASETS = ["click", "view", "purchase", "signup", "error"]


def releases_of(v: Views):
    """Every successful run released its scope when it finished."""
    return v.proc.where("status = 'SUCCESS'").select(*SCOPE, F.col("finished_at").alias("published_at"))


_RELEASE = "(SELECT task_name, business_date, max(finished_at) AS newest FROM v_proc WHERE status = 'SUCCESS' GROUP BY ALL)"
_HEALTH = """SELECT endpoint, count(*) AS request_count, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
    count(*) FILTER (WHERE wait_ms > 0) AS throttled_count, count(*) FILTER (WHERE row_count = 0) AS empty_count,
    strftime(max(requested_at), '%Y-%m-%d %H:%M:%S') AS last_requested_at, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95
    FROM v_req WHERE requested_at >= TIMESTAMP '2024-01-10' GROUP BY endpoint"""


@query("ops_endpoints", f"""
    WITH o AS ({_HEALTH}), names AS (SELECT unnest(['ep_click', 'ep_view', 'ep_purchase', 'ep_signup', 'ep_error', 'ep_dividend']) AS endpoint)
    SELECT endpoint, coalesce(request_count, 0) AS request_count, coalesce(success_count, 0) AS success_count, coalesce(throttled_count, 0) AS throttled_count,
           coalesce(empty_count, 0) AS empty_count, last_requested_at, p50, p95,
           CASE WHEN coalesce(request_count, 0) > 0 THEN CAST(success_count AS DOUBLE) / request_count END AS success_ratio
    FROM names LEFT JOIN o USING (endpoint)""")
def ops_endpoints(v: Views):
    names = [f"ep_{d}" for d in [*DATASETS, "dividend"]]
    registry = v.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("endpoint"))
    out = ops.endpoint_health(v.req, F.lit("2024-01-10").cast("timestamp_ntz"), registry)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})  # interpolation differs in the last bit


@query("ops_overview", f"""
    WITH recent AS (SELECT * FROM v_req WHERE requested_at >= TIMESTAMP '2024-01-10'),
    t AS (SELECT count(*) FILTER (WHERE status = 'SUCCESS') AS s, count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILED')) AS t FROM v_tsk WHERE finished_at >= TIMESTAMP '1999-01-01'),
    r AS (SELECT count(*) FILTER (WHERE status = 'SUCCESS') AS s, count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILED')) AS t FROM v_proc WHERE finished_at >= TIMESTAMP '1999-01-01'),
    x AS (SELECT (SELECT count(*) FROM v_bat WHERE batch_status = 'RUNNING') AS collecting,
      (SELECT count(*) FROM v_proc p LEFT JOIN {_RELEASE} n USING (task_name, business_date) WHERE p.status = 'QUEUED' AND NOT coalesce(n.newest > p.queued_at, false)) AS blocked,
      (SELECT t.s + r.s FROM t, r) AS task_success, (SELECT t.t + r.t FROM t, r) AS task_terminal,
      (SELECT count(*) FROM recent) AS provider_total, (SELECT count(*) FROM recent WHERE status = 'SUCCESS') AS provider_success,
      (SELECT round(quantile_cont(duration_ms, 0.95), 6) FROM recent) AS provider_p95)
    SELECT *, CAST(task_success AS DOUBLE) / task_terminal AS task_ratio, CAST(provider_success AS DOUBLE) / provider_total AS provider_ratio FROM x""")
def ops_overview(v: Views):
    out = ops.overview(v.bat, v.tsk, v.proc, v.req, releases_of(v), task_since=F.lit("1999-01-01").cast("timestamp_ntz"),
                       request_since=F.lit("2024-01-10").cast("timestamp_ntz"), scope=SCOPE)
    return out.withColumn("provider_p95", F.round("provider_p95", 6))


@query("ops_batches", """
    WITH c AS (SELECT batch_id, count(*) AS task_count, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
        count(*) FILTER (WHERE status = 'FAILED') AS failed_count, count(*) FILTER (WHERE status = 'RETRY_WAIT') AS retry_count FROM v_tsk GROUP BY batch_id)
    SELECT b.batch_id, coalesce(task_count, 0) AS task_count, coalesce(success_count, 0) AS success_count, coalesce(failed_count, 0) AS failed_count,
           coalesce(retry_count, 0) AS retry_count, CASE batch_status WHEN 'PENDING' THEN 'pending' WHEN 'RUNNING' THEN 'running'
           ELSE CASE WHEN coalesce(failed_count, 0) > 0 THEN 'partial_failed' ELSE 'succeeded' END END AS status
    FROM v_bat b LEFT JOIN c USING (batch_id) WHERE scheduled_at >= TIMESTAMP '1997-06-01'""")
def ops_batches(v: Views):
    out = ops.batch_list(v.bat, v.tsk, F.lit("1997-06-01").cast("timestamp_ntz"))
    return out.select("batch_id", "task_count", "success_count", "failed_count", "retry_count", "status")


@query("ops_queue", f"""
    WITH c AS (SELECT process_id, count(*) AS dependency_count, count(*) FILTER (WHERE status = 'READY') AS ready_count FROM v_dep GROUP BY process_id),
    q AS (SELECT p.process_id, p.task_name, p.business_date, p.priority, coalesce(c.dependency_count, 0) AS dependency_count, coalesce(c.ready_count, 0) AS ready_count, p.queued_at
      FROM v_proc p LEFT JOIN {_RELEASE} r USING (task_name, business_date) LEFT JOIN c USING (process_id)
      WHERE p.status = 'QUEUED' AND NOT coalesce(r.newest > coalesce(p.finished_at, p.queued_at), false))
    SELECT process_id, task_name, business_date, priority, dependency_count, ready_count, (SELECT count(*) FROM q) AS total
    FROM q ORDER BY priority, business_date NULLS FIRST, queued_at NULLS FIRST, process_id LIMIT 100""")
def ops_queue(v: Views):
    rows = ops.queue(v.proc, v.dep, releases_of(v), SCOPE)
    return page(rows, ops.queue_order(), 0, 100).select(
        "process_id", "task_name", "business_date", "priority", "dependency_count", "ready_count", "total")


_FAILED_TASKS = """
    WITH dated AS (SELECT t.*, b.scheduled_at, b.business_date FROM v_tsk t JOIN v_bat b USING (batch_id)),
    n AS (SELECT task_name, scope_key, max(finished_at) FILTER (WHERE status = 'SUCCESS') AS ok, max(scheduled_at) FILTER (WHERE status = 'RETRY_WAIT') AS act
          FROM dated GROUP BY ALL),
    open_ AS (SELECT d.* FROM dated d JOIN n USING (task_name, scope_key) WHERE d.status = 'FAILED'
          AND NOT coalesce(n.ok > d.finished_at, false) AND NOT coalesce(n.act > d.scheduled_at, false))"""
_FAILED_RUNS = f"""(SELECT p.* FROM v_proc p LEFT JOIN {_RELEASE} r USING (task_name, business_date)
    LEFT JOIN (SELECT task_name, business_date, max(queued_at) AS act FROM v_proc WHERE status = 'QUEUED' GROUP BY ALL) a USING (task_name, business_date)
    WHERE p.status = 'FAILED' AND NOT coalesce(r.newest > p.finished_at, false) AND NOT coalesce(a.act > p.finished_at, false))"""


@query("ops_unresolved", _FAILED_TASKS + f""",
    runs AS (SELECT 'acquisition' AS run_type, task_name, scope_key AS scope, batch_id AS id, scheduled_at, finished_at FROM open_
             UNION ALL SELECT 'processing', task_name, CAST(business_date AS VARCHAR), process_id, queued_at, finished_at FROM {_FAILED_RUNS})
    SELECT run_type, task_name, scope, id, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at FROM (
      SELECT *, row_number() OVER (PARTITION BY run_type, task_name, scope ORDER BY scheduled_at DESC, finished_at DESC NULLS LAST, id) AS rn FROM runs) WHERE rn = 1""")
def ops_unresolved(v: Views):
    tasks = ops.unresolved_collection(v.tsk, v.bat).select(
        "task_name", F.col("scope_key").alias("scope"), F.col("batch_id").alias("id"), "scheduled_at", "finished_at")
    runs = ops.unresolved_processing(v.proc, releases_of(v), SCOPE).select(
        "task_name", F.col("business_date").cast("string").alias("scope"), F.col("process_id").alias("id"),
        F.col("queued_at").alias("scheduled_at"), "finished_at")
    log = ops.run_log(tasks, runs)
    newest = ops.newest_per_scope(log, ["run_type", "task_name", "scope"], "scheduled_at", "id")
    return newest.select("run_type", "task_name", "scope", "id", "finished_at")


@query("ops_alerts", _FAILED_TASKS + f""",
    rows_ AS (SELECT 'acquisition' AS source, 'action_required' AS category, batch_id AS id, task_name, scope_key AS message, finished_at AS occurred_at,
                     'failure:' || task_name || ':' || scope_key AS group_key FROM open_
              UNION ALL SELECT 'acquisition', 'data_gap', batch_id, task_name, scope_key, finished_at, 'warning:' || task_name FROM v_tsk WHERE status = 'RETRY_WAIT'
              UNION ALL SELECT 'processing', 'action_required', process_id, task_name, CAST(business_date AS VARCHAR), finished_at, 'failure:' || task_name || ':' || CAST(business_date AS VARCHAR) FROM {_FAILED_RUNS}
              UNION ALL SELECT 'processing', 'quality', process_id, task_name, name, queued_at, 'warning:' || task_name FROM (
                  SELECT p.process_id, p.task_name, p.queued_at, d.name FROM v_proc p JOIN (SELECT process_id, max(name) AS name FROM v_dep GROUP BY ALL) d USING (process_id)
                  WHERE p.status = 'SUCCESS' AND NOT (d.name LIKE '%7' OR d.name LIKE 'api1'))
              UNION ALL SELECT 'scheduler', 'action_required', j.execution_id, j.job_id, CAST(j.k AS VARCHAR), j.created_at, 'scheduler:' || j.job_id FROM v_jobs j
                  LEFT JOIN (SELECT job_id, max(created_at) AS ok FROM v_jobs WHERE status = 'SUCCESS' GROUP BY ALL) s USING (job_id)
                  WHERE j.status = 'FAILED' AND NOT coalesce(s.ok > j.created_at, false)),
    ranked AS (SELECT *, count(*) OVER w AS alert_count, row_number() OVER (PARTITION BY category, source, group_key ORDER BY occurred_at DESC NULLS LAST, id, message) AS rn
               FROM rows_ WINDOW w AS (PARTITION BY category, source, group_key))
    SELECT category, source, group_key, alert_count, id,
           CASE WHEN alert_count > 1 THEN '同类告警共 ' || alert_count || ' 条，已聚合显示；最新记录：' || message ELSE message END AS message,
           strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM ranked WHERE rn = 1""")
def ops_alerts(v: Views):
    def branch(df, ident, task, message, at, group):
        return df.select(F.col(ident).alias("id"), F.col(task).alias("task_name"), message.alias("message"), F.col(at).alias("occurred_at"), group.alias("group_key"))

    failed = ops.unresolved_collection(v.tsk, v.bat)
    runs = ops.unresolved_processing(v.proc, releases_of(v), SCOPE)
    day = F.col("business_date").cast("string")
    warned = v.proc.where("status = 'SUCCESS'").join(v.dep.groupBy("process_id").agg(F.max("name").alias("name")), "process_id").where(
        ops.noteworthy("name", ["%7", "api1"]))
    ok = v.jobs.where("status = 'SUCCESS'").select("job_id", F.col("created_at").alias("ok_at"))
    broken = ops.recovered(v.jobs.where("status = 'FAILED'"), ok, ["job_id"], failed_at="created_at", success_at="ok_at").where(~F.col("recovered"))
    out = ops.alerts({
        "acquisition/failure": ("action_required", branch(failed, "batch_id", "task_name", F.col("scope_key"), "finished_at",
                                F.concat_ws(":", F.lit("failure"), "task_name", "scope_key"))),
        "acquisition/gap": ("data_gap", branch(v.tsk.where("status = 'RETRY_WAIT'"), "batch_id", "task_name", F.col("scope_key"), "finished_at",
                            F.concat_ws(":", F.lit("warning"), "task_name"))),
        "processing/failure": ("action_required", branch(runs, "process_id", "task_name", day, "finished_at", F.concat_ws(":", F.lit("failure"), "task_name", day))),
        "processing/quality": ("quality", branch(warned, "process_id", "task_name", F.col("name"), "queued_at", F.concat_ws(":", F.lit("warning"), "task_name"))),
        "scheduler/failure": ("action_required", branch(broken, "execution_id", "job_id", F.col("k").cast("string"), "created_at", F.concat_ws(":", F.lit("scheduler"), "job_id"))),
    })
    return out.select("category", "source", "group_key", "alert_count", "id", "message", "occurred_at")


@query("ops_sync_report", """
    WITH expected AS (SELECT DISTINCT job_id FROM v_jobs), disabled AS (SELECT 'job_' || code AS job_id FROM v_sec WHERE list_status = 'D'),
    today AS (SELECT job_id, arg_max(status, execution_id) AS status FROM v_jobs WHERE CAST(created_at AS DATE) = DATE '2024-01-15' GROUP BY job_id)
    SELECT e.job_id, coalesce(t.status, 'NOT_RUN') AS status FROM expected e ANTI JOIN disabled d USING (job_id) LEFT JOIN today t USING (job_id)
    WHERE t.status IS DISTINCT FROM 'SUCCESS'""")
def ops_sync_report(v: Views):
    disabled = v.sec.where("list_status = 'D'").select(F.concat(F.lit("job_"), "code").alias("job_id"))
    return ops.sync_report(v.jobs.select("job_id").distinct(), disabled, v.jobs, F.lit("2024-01-15").cast("date"))


# ---------------------------------------------------------------- coverage and recovery

_DAYS = "(SELECT cal_date AS trade_date FROM v_cal WHERE exchange = 'ASIA' AND is_open AND cal_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-28')"
_NAMES = "(SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS dataset)"


def open_days(v: Views):
    return ops.trading_days(v.cal, "ASIA", "2024-01-02", "2024-01-28").withColumnRenamed("cal_date", "trade_date")


@query("cal_trading_days", f"SELECT trade_date FROM {_DAYS}")
def cal_trading_days(v: Views):
    return open_days(v)


@query("cov_missing", f"""
    SELECT d.trade_date, count(*) AS expected, count(r.dataset) AS published,
           coalesce(string_agg(CASE WHEN r.dataset IS NULL THEN n.dataset END, ',' ORDER BY n.dataset), '') AS missing,
           CASE WHEN count(*) = count(r.dataset) THEN 'complete' WHEN d.trade_date = DATE '2024-01-26' THEN 'pending' ELSE 'missing' END AS coverage
    FROM {_DAYS} d CROSS JOIN {_NAMES} n LEFT JOIN v_rel r ON r.dataset = n.dataset AND r.trade_date = d.trade_date GROUP BY d.trade_date""")
def cov_missing(v: Views):
    return ops.coverage(open_days(v), DATASETS, v.rel, F.lit("2024-01-26").cast("date"))


@query("cov_recovery_plan", f"""
    SELECT DISTINCT m.trade_date, 'ep_' || m.dataset AS endpoint FROM (SELECT trade_date, dataset FROM {_DAYS} CROSS JOIN {_NAMES} ANTI JOIN v_rel USING (trade_date, dataset)) m
    ANTI JOIN (SELECT CAST(requested_at AS DATE) AS trade_date, endpoint FROM v_req GROUP BY ALL HAVING count(*) >= 75) a
      ON a.trade_date = m.trade_date AND a.endpoint = 'ep_' || m.dataset""")
def cov_recovery_plan(v: Views):
    missing = ops.missing_datasets(open_days(v), DATASETS, v.rel)
    inputs = v.rel.select("dataset").distinct().withColumn("endpoint", F.concat(F.lit("ep_"), "dataset"))
    active = v.req.groupBy(F.to_date("requested_at").alias("trade_date"), "endpoint").agg(F.count("*").alias("n")).where("n >= 75")
    return ops.recovery_plan(missing, inputs, active)


@query("ops_retry_collect", _FAILED_TASKS + """
    SELECT business_date, count(*) AS retry_count FROM (
      SELECT *, row_number() OVER (PARTITION BY task_name, scope_key ORDER BY scheduled_at DESC, finished_at DESC NULLS LAST, batch_id) AS rn
      FROM open_ WHERE scheduled_at >= TIMESTAMP '1996-01-01') WHERE rn = 1 GROUP BY business_date""")
def ops_retry_collect(v: Views):
    return ops.retry_worklist(ops.unresolved_collection(v.tsk, v.bat), ["task_name", "scope_key"], "business_date",
                              sort_time="scheduled_at", tie="batch_id", since=F.lit("1996-01-01").cast("timestamp_ntz"))


@query("ops_retry_process", f"""
    SELECT business_date, count(*) AS retry_count FROM (
      SELECT *, row_number() OVER (PARTITION BY task_name, business_date ORDER BY queued_at DESC, finished_at DESC NULLS LAST, process_id) AS rn
      FROM {_FAILED_RUNS} WHERE queued_at >= TIMESTAMP '1996-01-01') WHERE rn = 1 GROUP BY business_date""")
def ops_retry_process(v: Views):
    return ops.retry_worklist(ops.unresolved_processing(v.proc, releases_of(v), SCOPE), SCOPE, "business_date",
                              sort_time="queued_at", tie="process_id", since=F.lit("1996-01-01").cast("timestamp_ntz"))


# ---------------------------------------------------------------- lineage


def _edges(v: Views):
    """Nation -> region -> exchange-wide dataset: a three-level dependency graph from the masters."""
    sup = v.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("upstream"),
                                     F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("downstream"))
    nat = v.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("upstream"),
                                   F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("downstream"))
    back = v.table("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("upstream"), F.lit("MARKET").alias("downstream"))
    return sup.unionByName(nat).unionByName(back)


@query("lin_closure", """
    WITH RECURSIVE edges AS (SELECT 'S' || s_suppkey AS upstream, 'N' || s_nationkey AS downstream FROM supplier
        UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'MARKET' FROM region),
    walk AS (SELECT 'S' || s_suppkey AS name, 0 AS depth FROM supplier WHERE s_acctbal < 0
        UNION SELECT e.downstream, w.depth + 1 FROM walk w JOIN edges e ON e.upstream = w.name)
    SELECT name, min(depth) AS depth FROM walk GROUP BY name""")
def lin_closure(v: Views):
    seeds = v.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return ln.affected_closure(_edges(v), seeds)


_RESOLVE = """
    cur AS (SELECT task_name AS name, scope_key AS scope, arg_max(batch_id, batch_id) AS asset_id,
                   arg_max(status, batch_id) AS run_status FROM (SELECT task_name, scope_key, batch_id, max(status) AS status FROM v_tsk
                   WHERE finished_at >= TIMESTAMP '2000-01-01' GROUP BY ALL) GROUP BY ALL),
    pri AS (SELECT task_name AS name, scope_key AS scope, max(batch_id) AS prior_id FROM v_tsk WHERE finished_at < TIMESTAMP '2000-01-01' AND status = 'SUCCESS' GROUP BY ALL),
    res AS (SELECT d.process_id, d.name, d.scope, CASE WHEN run_status = 'SUCCESS' THEN asset_id ELSE prior_id END AS resolved_id, run_status
            FROM (SELECT DISTINCT process_id, name, scope FROM v_dep) d LEFT JOIN cur USING (name, scope) LEFT JOIN pri USING (name, scope)),
    done AS (SELECT process_id, name, scope, resolved_id, CASE WHEN resolved_id IS NOT NULL THEN 'READY' WHEN run_status = 'FAILED' THEN 'FAILED'
             WHEN run_status IS NOT NULL THEN 'WAITING' ELSE 'MISSING' END AS status FROM res)"""


def _resolved(v: Views):
    edge = F.lit("2000-01-01").cast("timestamp_ntz")
    recent = v.tsk.where(F.col("finished_at") >= edge).groupBy("task_name", "scope_key", "batch_id").agg(F.max("status").alias("status"))
    current = recent.groupBy(F.col("task_name").alias("name"), F.col("scope_key").alias("scope")).agg(
        F.max("batch_id").alias("asset_id"), F.max_by("status", "batch_id").alias("run_status"))
    prior = v.tsk.where((F.col("finished_at") < edge) & (F.col("status") == "SUCCESS")).groupBy(
        F.col("task_name").alias("name"), F.col("scope_key").alias("scope")).agg(F.max("batch_id").alias("prior_id"))
    deps = v.dep.select("process_id", "name", "scope").distinct()
    return ln.resolve_dependencies(deps, current, prior)


@query("lin_resolve", f"WITH {_RESOLVE} SELECT process_id, name, scope, resolved_id, status FROM done")
def lin_resolve(v: Views):
    return _resolved(v).select("process_id", "name", "scope", "resolved_id", "status")


@query("lin_impact", f"""WITH {_RESOLVE},
    changed AS (SELECT batch_id FROM v_bat WHERE batch_status = 'RUNNING'),
    hit AS (SELECT DISTINCT process_id FROM done WHERE resolved_id IN (SELECT batch_id FROM changed))
    SELECT process_id, CASE WHEN bool_and(status = 'READY') THEN 'QUEUED' WHEN bool_or(status IN ('MISSING', 'FAILED')) THEN 'BLOCKED' ELSE 'WAITING' END AS readiness
    FROM done WHERE process_id IN (SELECT process_id FROM hit) GROUP BY process_id""")
def lin_impact(v: Views):
    changed = v.bat.where("batch_status = 'RUNNING'").select(F.col("batch_id").alias("asset_id"))
    return ln.impact(_resolved(v), changed)
