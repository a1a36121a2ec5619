"""Rollups: conditional counts, percentiles, readiness, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, keys: Sequence[str], families: Mapping[str, Column], total_as: str | None = "total") -> DataFrame:
    """One count per status family, in a single partial aggregation."""
    aggs = [F.count("*").alias(total_as)] if total_as else []
    aggs += [F.count_if(cond).alias(name) for name, cond in families.items()]
    return df.groupBy(*keys).agg(*aggs)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Continuous percentiles over a value histogram.

    Counting per (key, value) first means a hot key reaches its final task as one row per
    distinct value (durations are whole milliseconds), not one per log row.
    """
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_f"))
    return histogram.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p), F.col("_f")).alias(name) for name, p in points.items()]
    )


def group_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def histogram(df: DataFrame, key: str, count_as: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(count_as))


def readiness(deps: DataFrame, key: str, status: str = "status", out: str = "readiness") -> DataFrame:
    """All inputs READY -> QUEUED; any MISSING or FAILED -> BLOCKED; otherwise WAITING."""
    return deps.groupBy(key).agg(
        F.when(F.bool_and(F.col(status) == "READY"), "QUEUED")
        .when(F.bool_or(F.col(status).isin("MISSING", "FAILED")), "BLOCKED")
        .otherwise("WAITING").alias(out)
    )


def source_summary(deps: DataFrame, keys: Sequence[str], status: str = "status", reason: str = "blocked_reason") -> DataFrame:
    s = F.col(status)
    counts = conditional_counts(
        deps, keys,
        {"ready": s == "READY", "waiting": s == "WAITING", "blocked": s.isin("MISSING", "FAILED")},
        "required",
    )
    return counts.join(deps.groupBy(*keys).agg(F.max(reason).alias(reason)), list(keys))


def batch_completeness(batches: DataFrame, tasks: DataFrame, key: str, terminal: Column, expected: str) -> DataFrame:
    """Actual against expected task count and whether every task has ended."""
    actual = tasks.groupBy(key).agg(F.count("*").alias("actual"), F.bool_and(terminal).alias("all_terminal"))
    return batches.join(actual, key, "left").select(
        key, expected, F.coalesce("actual", F.lit(0)).alias("actual"),
        (F.coalesce("all_terminal", F.lit(False)) & (F.coalesce("actual", F.lit(0)) == F.col(expected))).alias("complete"),
    )


def known_datasets(releases: DataFrame, dataset: str = "dataset") -> DataFrame:
    return releases.select(dataset).distinct().orderBy(dataset)


def touched_months(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """Month partitions a write touches, with their half-open bounds."""
    month = F.trunc(day, "MM")
    return df.select(month.alias("month_start")).groupBy("month_start").agg(F.count("*").alias("rows")).select(
        "month_start", F.add_months("month_start", 1).alias("month_end"), "rows",
        F.date_format(F.col("month_start").cast("timestamp_ntz"), "yyyy-MM").alias("month_key"),
    )


def trailing_quota(requests: DataFrame, end: Column, *, seconds: int, budget: int, at: str = "requested_at", wait: str = "wait_ms") -> DataFrame:
    """Requests used and delayed in the window that ends at ``end``, and what is left."""
    inside = F.col(at) >= end - F.expr(f"interval {seconds} seconds")
    return requests.where(inside).agg(
        F.count("*").alias("used"), F.count_if(F.col(wait) > 0).alias("delayed")
    ).withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("used")))
