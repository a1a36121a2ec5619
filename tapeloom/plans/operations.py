"""Operations read models: analytics over batch, task, dependency, request and release logs.

"A later success exists" is always computed as the newest success per scope joined back
by equality, so no read model holds an inequality join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.predicates import not_like_any
from tapeloom.functions.scalar import duration_ms, ratio, relabel
from tapeloom.operators.aggregates import conditional_counts, exact_percentiles
from tapeloom.operators.joins import parents_with_child, recovered, registry_metrics
from tapeloom.operators.ranking import latest_per_key, micros, representative
from tapeloom.operators.sets import missing_from, union_tagged

# Status families.
COLLECTION_SUCCESS = ("SUCCESS", "EMPTY_VALID")
COLLECTION_FAILED = ("FAILED", "SKIPPED", "CANCELLED")
COLLECTION_ACTIVE = ("PENDING", "RUNNING", "RETRY_WAIT")
COLLECTION_TERMINAL = COLLECTION_SUCCESS + COLLECTION_FAILED
PROCESSING_SUCCESS = ("SUCCESS",)
PROCESSING_FAILED = ("FAILED", "SKIPPED", "CANCELLED")
PROCESSING_ACTIVE = ("WAITING_DEPENDENCY", "QUEUED", "RUNNING", "RETRY_WAIT", "BLOCKED")
PROCESSING_TERMINAL = PROCESSING_SUCCESS + PROCESSING_FAILED

# Display states.
STATUS_LABELS = {
    "PENDING": "pending", "QUEUED": "pending", "RUNNING": "running", "RETRY_WAIT": "waiting_retry",
    "WAITING_DEPENDENCY": "waiting_dependency", "SUCCESS": "succeeded", "EMPTY_VALID": "succeeded",
    "BLOCKED": "blocked", "FAILED": "failed", "SKIPPED": "failed", "CANCELLED": "failed",
}
BATCH_TYPE_LABELS = {"REPAIR": "manual", "BACKFILL": "manual"}


def status_label(status: str = "status") -> Column:
    return relabel(status, STATUS_LABELS)


def batch_status_label(status: str, failed: str) -> Column:
    s = F.col(status)
    return (
        F.when(s == "PENDING", "pending").when(s == "RUNNING", "running")
        .when((s == "CLOSED") & (F.col(failed) > 0), "partial_failed").when(s == "CLOSED", "succeeded")
        .otherwise("failed")
    )


def priority_label(priority: str) -> Column:
    p = F.col(priority)
    return (
        F.when(p <= 100, "current_normal").when(p <= 200, "auto_supplement")
        .when(p <= 300, "manual_rerun").otherwise("historical")
    )


# ---------------------------------------------------------------- health and lists


def endpoint_health(requests: DataFrame, since: Column, registry: DataFrame | None = None) -> DataFrame:
    """Per endpoint: volume, success ratio, exact p50 / p95, throttled and empty calls, last seen."""
    recent = requests.where(F.col("requested_at") >= since)
    counts = recent.groupBy("endpoint").agg(
        F.count("*").alias("request_count"), F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("wait_ms") > 0).alias("throttled_count"), F.count_if(F.col("row_count") == 0).alias("empty_count"),
        F.max("requested_at").alias("last_requested_at"),
    )
    points = exact_percentiles(recent, ["endpoint"], "duration_ms", {"p50": 0.5, "p95": 0.95})
    out = counts.join(points, "endpoint", "left")
    if registry is not None:
        out = registry_metrics(registry, out, "endpoint", ["request_count", "success_count", "throttled_count", "empty_count"])
    return out.withColumn("success_ratio", ratio("success_count", "request_count"))


def overview(batches: DataFrame, tasks: DataFrame, processing: DataFrame, requests: DataFrame, releases: DataFrame, *, task_since: Column, request_since: Column, scope: Sequence[str]) -> DataFrame:
    """One row of headline numbers; each part is its own small aggregate."""
    collecting = batches.agg(F.count_if(F.col("batch_status") == "RUNNING")).scalar()
    blocked_runs = processing.where(F.col("status").isin("BLOCKED", "QUEUED"))
    open_runs = recovered(blocked_runs, releases, scope, failed_at="queued_at", success_at="published_at")
    blocked = open_runs.agg(F.count_if(~F.col("recovered"))).scalar()
    done = tasks.where(F.col("finished_at") >= task_since).agg(
        F.count_if(F.col("status").isin(*COLLECTION_SUCCESS)).alias("s"), F.count_if(F.col("status").isin(*COLLECTION_TERMINAL)).alias("t"))
    runs = processing.where(F.col("finished_at") >= task_since).agg(
        F.count_if(F.col("status").isin(*PROCESSING_SUCCESS)).alias("s"), F.count_if(F.col("status").isin(*PROCESSING_TERMINAL)).alias("t"))
    recent = requests.where(F.col("requested_at") >= request_since)
    p95 = exact_percentiles(recent.withColumn("_all", F.lit(1)), ["_all"], "duration_ms", {"p95": 0.95}).select("p95").scalar()
    base = recent.agg(F.count("*").alias("provider_total"), F.count_if(F.col("status") == "SUCCESS").alias("provider_success"))
    out = base.select(
        collecting.alias("collecting"), blocked.alias("blocked"),
        (done.select("s").scalar() + runs.select("s").scalar()).alias("task_success"),
        (done.select("t").scalar() + runs.select("t").scalar()).alias("task_terminal"),
        "provider_total", "provider_success", p95.alias("provider_p95"),
    )
    return out.withColumns({
        "task_ratio": ratio("task_success", "task_terminal"), "provider_ratio": ratio("provider_success", "provider_total")})


def batch_list(batches: DataFrame, tasks: DataFrame, since: Column) -> DataFrame:
    """Batches with task counts and a derived status."""
    counts = conditional_counts(tasks, ["batch_id"], {
        "success_count": F.col("status").isin(*COLLECTION_SUCCESS),
        "failed_count": F.col("status").isin(*COLLECTION_FAILED),
        "retry_count": F.col("status") == "RETRY_WAIT"}, "task_count")
    names = ["task_count", "success_count", "failed_count", "retry_count"]
    out = batches.where(F.col("scheduled_at") >= since).join(counts, "batch_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
    return out.withColumn("status", batch_status_label("batch_status", "failed_count"))


def batch_filter(status: str) -> Column:
    """Filter matching a display status on a batch list."""
    choices = {
        "pending": F.col("batch_status") == "PENDING", "running": F.col("batch_status") == "RUNNING",
        "waiting_retry": F.col("retry_count") > 0,
        "succeeded": (F.col("batch_status") == "CLOSED") & (F.col("failed_count") == 0),
        "closed": (F.col("batch_status") == "CLOSED") & (F.col("failed_count") == 0),
        "partial_failed": (F.col("batch_status") == "CLOSED") & (F.col("failed_count") > 0),
        "failed": F.col("batch_status") == "CANCELLED",
    }
    return choices.get(status, F.lit(False))


def queue(processing: DataFrame, dependencies: DataFrame, releases: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Active runs with their dependency counts, hidden once a newer release exists."""
    active = processing.where(F.col("status").isin(*PROCESSING_ACTIVE)).withColumn(
        "_since", F.coalesce("finished_at", "queued_at"))
    open_runs = recovered(active, releases, scope, failed_at="_since", success_at="published_at").where(~F.col("recovered"))
    counts = conditional_counts(dependencies, ["process_id"], {"ready_count": F.col("status") == "READY"}, "dependency_count")
    out = open_runs.join(counts, "process_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("dependency_count", "ready_count")}).drop("_since", "recovered")


def queue_order() -> list[Column]:
    """Running first, then priority, oldest business date and queue time (NULLs first), id."""
    return [
        F.when(F.col("status") == "RUNNING", 0).otherwise(1).asc(), F.col("priority").asc(),
        F.col("business_date").asc_nulls_first(), F.col("queued_at").asc_nulls_first(), F.col("process_id").asc(),
    ]


def dependency_list(processing: DataFrame, dependencies: DataFrame, releases: DataFrame, scope: Sequence[str], *, view: str = "attention", text: str | None = None) -> DataFrame:
    """Runs with dependency counts under the attention / waiting / blocked / ready view."""
    counts = conditional_counts(dependencies, ["process_id"], {
        "ready_count": F.col("status") == "READY", "waiting_count": F.col("status") == "WAITING",
        "blocked_count": F.col("status").isin("MISSING", "FAILED")}, "dependency_count")
    runs = processing
    if text:
        needle = F.lower(F.lit(text))
        child = F.contains(F.lower("name"), needle) | F.contains(F.lower("scope"), needle)
        runs = parents_with_child(runs, dependencies, "process_id", child, F.contains(F.lower("task_name"), needle))
    out = recovered(runs, releases, scope, failed_at="queued_at", success_at="published_at").join(counts, "process_id")
    open_, finished = ~F.col("recovered"), F.col("status").isin("SKIPPED", "CANCELLED")
    ended = F.col("status").isin("SUCCESS", "SKIPPED", "CANCELLED")
    views = {
        "attention": ~ended & (F.col("ready_count") < F.col("dependency_count")) & open_,
        "waiting": ~ended & (F.col("waiting_count") > 0) & (F.col("blocked_count") == 0) & open_,
        "blocked": ~ended & (F.col("blocked_count") > 0) & open_ & ~finished,
        "ready": F.col("ready_count") == F.col("dependency_count"),
        "all": F.lit(True),
    }
    return out.where(views[view])


# ---------------------------------------------------------------- runs and alerts


def run_log(tasks: DataFrame, processing: DataFrame, *, kinds: Sequence[str] = ("acquisition", "processing")) -> DataFrame:
    """Collection and processing runs as one log; only the requested branches are built."""
    parts = {}
    if "acquisition" in kinds:
        parts["acquisition"] = tasks
    if "processing" in kinds:
        parts["processing"] = processing
    return union_tagged(parts, "run_type")


def unresolved_collection(tasks: DataFrame, batches: DataFrame, statuses: Sequence[str] = ("FAILED",)) -> DataFrame:
    """Failed tasks with neither a later success nor a newer active task of their scope."""
    scope = ["task_name", "scope_key"]
    dated = tasks.join(batches.select("batch_id", "scheduled_at", "business_date"), "batch_id")
    newest = dated.groupBy(*scope).agg(
        F.max(F.when(F.col("status").isin(*COLLECTION_SUCCESS), F.col("finished_at"))).alias("_success"),
        F.max(F.when(F.col("status").isin(*COLLECTION_ACTIVE), F.col("scheduled_at"))).alias("_active"),
    )
    failed = dated.where(F.col("status").isin(*statuses)).join(newest, scope)
    gone = F.coalesce(F.col("_success") > F.col("finished_at"), F.lit(False)) | F.coalesce(
        F.col("_active") > F.col("scheduled_at"), F.lit(False))
    return failed.where(~gone).drop("_success", "_active")


def unresolved_processing(processing: DataFrame, releases: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Failed runs with neither a newer release nor a newer active run of their scope."""
    active = processing.where(F.col("status").isin(*PROCESSING_ACTIVE)).groupBy(*scope).agg(F.max("queued_at").alias("_active"))
    newest = releases.groupBy(*scope).agg(F.max("published_at").alias("_release"))
    failed = processing.where("status = 'FAILED'").join(newest, list(scope), "left").join(active, list(scope), "left")
    occurred = F.coalesce("finished_at", "queued_at")
    gone = F.coalesce(F.col("_release") > occurred, F.lit(False)) | F.coalesce(F.col("_active") > occurred, F.lit(False))
    return failed.where(~gone).drop("_release", "_active")


def newest_per_scope(failures: DataFrame, scope: Sequence[str], sort_time: str, tie: str) -> DataFrame:
    """One failure per logical scope: newest start, newest end (NULL last), then id."""
    return latest_per_key(failures, scope, [F.col(sort_time).desc(), F.col("finished_at").desc_nulls_last(), F.col(tie).asc()])


# Warnings that need no attention.
ROUTINE_WARNINGS = (
    "%个证券历史代码映射为现行代码%",
    "%重复记录仅有名称或数值精度差异，已确定性合并%",
    "%完全重复记录，加工时已确定性去重%",
)


def noteworthy(warning: str, patterns: Sequence[str] = ROUTINE_WARNINGS) -> Column:
    return F.col(warning).isNotNull() & not_like_any(warning, patterns)


def alerts(branches: dict[str, tuple[str, DataFrame]], *, category: str = "all", source: str | None = None) -> DataFrame:
    """Alerts grouped by (category, source, group_key) with their count and newest member.

    ``branches`` maps a branch name "source/category" to frames with id, task_name,
    message, occurred_at and group_key; branches that were not asked for are not built.
    """
    chosen = {}
    for name, (kind, frame) in branches.items():
        origin = name.split("/")[0]
        if source in (None, origin) and category in ("all", kind):
            chosen[name] = frame.withColumns({"source": F.lit(origin), "category": F.lit(kind)})
    rows = union_tagged(chosen, "branch").drop("branch")
    newest = F.struct(F.col("occurred_at").isNull(), -micros("occurred_at"), F.col("id"), F.col("message"))
    grouped = representative(rows, ["category", "source", "group_key"], newest, ["id", "task_name", "message", "occurred_at"], "alert_count")
    many = F.concat(
        F.lit("同类告警共 "), F.col("alert_count").cast("string"), F.lit(" 条，已聚合显示；最新记录："),
        F.coalesce("message", F.lit("")))
    return grouped.withColumn("message", F.when(F.col("alert_count") > 1, many).otherwise(F.col("message")))


def alert_order() -> list[Column]:
    return [F.col("occurred_at").desc_nulls_last(), F.col("id").asc()]


# ---------------------------------------------------------------- coverage and recovery


def trading_days(cal: DataFrame, exchange: str, start: str, end: str) -> DataFrame:
    """Open days of an exchange; no rows unless the calendar covers the whole span."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    span = cal.where((F.col("exchange") == exchange) & F.col("cal_date").between(lo, hi))
    covered = span.agg(F.count("*")).scalar()
    return span.where(F.col("is_open") & (covered == F.datediff(hi, lo) + 1)).select("cal_date")


def coverage(days: DataFrame, datasets: Sequence[str], releases: DataFrame, today: Column, *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    """Expected, published and missing datasets per trading day."""
    expected = days.withColumn(dataset, F.explode(F.array(*[F.lit(d) for d in datasets])))
    have = releases.select(day, dataset).distinct().withColumn("_hit", F.lit(True))
    out = expected.join(have, [day, dataset], "left").groupBy(day).agg(
        F.count("*").alias("expected"), F.count("_hit").alias("published"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col(dataset))))).alias("missing"),
    )
    return out.withColumn(
        "coverage", F.when(F.col("expected") == F.col("published"), "complete").when(F.col(day) == today, "pending").otherwise("missing"))


def missing_datasets(days: DataFrame, datasets: Sequence[str], releases: DataFrame, *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    expected = days.withColumn(dataset, F.explode(F.array(*[F.lit(d) for d in datasets])))
    return missing_from(expected, releases, [day, dataset])


def recovery_plan(missing: DataFrame, inputs: DataFrame, active: DataFrame, *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    """Endpoints to fetch again per date: inputs of the missing datasets minus active ones."""
    needed = missing.join(inputs, dataset).select(day, "endpoint").distinct()
    return missing_from(needed, active, [day, "endpoint"])


def retry_worklist(failures: DataFrame, scope: Sequence[str], group: str, *, sort_time: str, tie: str, since: Column) -> DataFrame:
    """Newest unresolved failure per scope within the window, counted by business date."""
    picked = newest_per_scope(failures.where(F.col(sort_time) >= since), scope, sort_time, tie)
    return picked.groupBy(group).agg(F.count("*").alias("retry_count"))


def sync_report(expected_jobs: DataFrame, disabled: DataFrame, executions: DataFrame, day: Column) -> DataFrame:
    """Expected, enabled jobs whose latest run of the day is absent or not successful."""
    todays = executions.where(F.to_date("created_at") == day)
    newest = todays.groupBy("job_id").agg(F.max_by("status", F.struct("created_at", "execution_id")).alias("status"))
    wanted = missing_from(expected_jobs, disabled, ["job_id"])
    return wanted.join(newest, "job_id", "left").where(~F.col("status").eqNullSafe(F.lit("SUCCESS"))).withColumn(
        "status", F.coalesce("status", F.lit("NOT_RUN")))


def run_duration(df: DataFrame, started: str, finished: str, now: Column) -> DataFrame:
    return df.withColumn("duration_ms", duration_ms(started, finished, now))
