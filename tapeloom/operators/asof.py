"""Release gating and as-of resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.errors import QueryError
from tapeloom.session import scratch_path

#: A key with more rows is scanned in several buckets of about that many.
BUCKET_ROWS = 1_000_000
#: A key has at most 2 ** BUCKET_LEVELS buckets; beyond that they grow with it.
BUCKET_LEVELS = 10


def joint_dates(releases: DataFrame, datasets: Sequence[str], *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    """Dates on which every named dataset is released."""
    names = list(dict.fromkeys(datasets))
    if not names:
        raise QueryError("INVALID_REQUEST", "at least one dataset is required")
    return (
        releases.where(F.col(dataset).isin(*names) & F.col(day).isNotNull())
        .groupBy(day).agg(F.count_distinct(dataset).alias("_n"))
        .where(F.col("_n") == len(names)).select(day)
    )


def latest_joint(releases: DataFrame, datasets: Sequence[str], requested: str | None = None, *, dataset: str = "dataset", day: str = "trade_date") -> Column:
    """Newest jointly released date as a scalar subquery; NULL when there is none.

    Used inside a filter it keeps the whole question one lazy plan.
    """
    dates = joint_dates(releases, datasets, dataset=dataset, day=day)
    if requested is not None:
        dates = dates.where(F.col(day) == F.lit(requested).cast("date"))
    return dates.agg(F.max(day)).scalar()


def require_joint(releases: DataFrame, datasets: Sequence[str], requested: str | None = None, *, dataset: str = "dataset", day: str = "trade_date") -> object:
    """Resolve the date eagerly (one value) and fail when nothing is released."""
    dates = joint_dates(releases, datasets, dataset=dataset, day=day)
    if requested is not None:
        dates = dates.where(F.col(day) == F.lit(requested).cast("date"))
    found = dates.agg(F.max(day)).first()[0]
    if found is None:
        raise QueryError("DATA_NOT_READY", "no joint release", datasets=list(datasets), requested=requested)
    return found


def gate(facts: DataFrame, releases: DataFrame, datasets: Sequence[str], *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    """Facts on jointly released dates only."""
    return facts.join(joint_dates(releases, datasets, dataset=dataset, day=day), day, "left_semi")


def bucket_limits(events: DataFrame, by: Sequence[str], time: str, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``by`` and ``_limits``: the times that cut a key with over ``bucket_rows`` rows into a power of two of about equal parts.

    Rows are counted with map-side combine; only keys found hot get a quantile sketch, so the table has at most one row per
    ``bucket_rows`` input rows. It is written: a sketch depends on the order in which it was merged, and all readers have to see
    the same limits, also after a lost executor.
    """
    parts = 2 ** BUCKET_LEVELS
    hot = events.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > bucket_rows)
    level = F.least(F.ceil(F.log2(F.col("_n") / bucket_rows)), F.lit(BUCKET_LEVELS))
    stride = F.pow(2, BUCKET_LEVELS - level).cast("int")
    sketch = events.join(hot, list(by)).groupBy(*by, "_n").agg(
        F.percentile_approx(time, [i / parts for i in range(1, parts)], 16 * parts).alias("_all"))
    limits = sketch.withColumn("_stride", stride).select(
        *by, F.filter("_all", lambda limit, i: (i + 1) % F.col("_stride") == 0).alias("_limits"))
    path = scratch_path(events.sparkSession, "asof-limits")
    limits.write.parquet(path)
    return events.sparkSession.read.schema(limits.schema).parquet(path)


def in_buckets(events: DataFrame, limits: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Events with ``_b``, the number of their key's limits before their time, found by halving; 0 for keys without limits."""
    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(F.col("_limits"), at + width - 1) < F.col(time), at + width).otherwise(at)

    widths = F.array(*[F.lit(2 ** i) for i in reversed(range(BUCKET_LEVELS))])
    bucket = F.when(F.col("_limits").isNull(), 0).otherwise(F.aggregate(widths, F.lit(0), step))
    return events.join(limits, list(by), "left").withColumn("_b", bucket).drop("_limits")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], *, left_time: str, right_time: str,
    columns: Sequence[str], bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Newest right row at or before each left row's time, per key, exactly.

    Both sides are merged and scanned in time order, so no pairs are produced. A key with over ``bucket_rows`` rows is split
    into buckets of about equal volume, however its times are spread: inside a bucket a running last-value is taken, and
    what earlier buckets carry in comes from a window over one row per bucket (at most 2 ** BUCKET_LEVELS a key). Of right rows
    with equal key and time, the one with the greatest columns counts. Left rows with a null key or time find nothing.
    """
    by = list(by)
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    asked = left.where(usable & F.col(left_time).isNotNull())
    known = right.where(usable & F.col(right_time).isNotNull())
    times = asked.select(*by, F.col(left_time).alias("_t")).unionByName(known.select(*by, F.col(right_time).alias("_t")))
    limits = bucket_limits(times, by, "_t", bucket_rows=bucket_rows)
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(c) for c in columns])
    probe = asked.select(*by, F.col(left_time).alias("_t")).distinct().select(*by, "_t", F.lit(1).alias("_side"))
    build = (
        known.groupBy(*by, right_time).agg(F.max(payload).alias("_p"))
        .select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), "_p")
    )
    merged = in_buckets(build.unionByName(probe, allowMissingColumns=True), limits, by, "_t")
    inside = Window.partitionBy(*by, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    scanned = merged.withColumn("_in", F.last("_p", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        merged.groupBy(*by, "_b").agg(F.max_by("_p", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    )
    resolved = scanned.join(carry, [*by, "_b"], "left").select(
        *by, F.col("_t").alias(left_time), F.coalesce("_in", "_carry").alias("_m"))
    return left.join(resolved, [*by, left_time], "left").select(
        *left.columns, F.col("_m._t").alias(f"asof_{right_time}"), *[F.col(f"_m.{c}").alias(c) for c in columns])


def asof_release(requests: DataFrame, releases: DataFrame, *, dataset: str = "dataset", asked: str = "asked", day: str = "trade_date") -> DataFrame:
    """Latest release of a dataset at or before each requested day."""
    dated = releases.select(dataset, day).distinct()
    return asof_join(requests, dated, [dataset], left_time=asked, right_time=day, columns=[]).withColumnRenamed(
        f"asof_{day}", "resolved")


def asof_snapshot(members: DataFrame, keys: Sequence[str], snapshot: str, through: Column) -> DataFrame:
    """Rows of each key's newest snapshot at or before ``through``."""
    eligible = members.where(F.col(snapshot) <= through)
    newest = eligible.groupBy(*keys).agg(F.max(snapshot).alias(snapshot))
    return eligible.join(newest, [*keys, snapshot], "left_semi")
