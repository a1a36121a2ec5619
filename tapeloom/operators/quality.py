"""Checks. Each returns a frame of violations or a per-scope verdict; nothing is collected.

Pipelines turn a verdict into an error through :func:`enforce`, which reads one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import types as tt
from tapeloom.errors import QualityError
from tapeloom.functions.predicates import ohlc_invalid
from tapeloom.functions.scalar import strict_date, within


def natural_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are blank in any part or occur more than once."""
    blank = reduce(lambda a, b: a | b, [
        F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    problem = F.when(blank, "blank").when(F.col("n") > 1, "duplicate")
    return counts.withColumn("problem", problem).where(F.col("problem").isNotNull())


def wrong_business_date(df: DataFrame, raw_date: str, business_date: Column) -> DataFrame:
    """Rows whose own date is invalid or differs from the asset's date."""
    return df.where(~strict_date(raw_date).eqNullSafe(business_date))


def distinct_dates(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Number of business dates in each batch; a batch must have exactly one."""
    return df.groupBy(*keys).agg(F.count_distinct(day).alias("n_dates"))


def truncation_suspects(df: DataFrame, scope: Sequence[str], caps: DataFrame | int, *, cap: str = "row_cap") -> DataFrame:
    """Scopes that returned at least their row cap."""
    counts = df.groupBy(*scope).agg(F.count("*").alias("n"))
    if isinstance(caps, DataFrame):
        shared = [c for c in scope if c in caps.columns]
        counts = counts.join(caps, shared)
    else:
        counts = counts.withColumn(cap, F.lit(caps))
    return counts.withColumn("truncated", F.col("n") >= F.col(cap))


def calendar_completeness(cal: DataFrame, exchange: str = "exchange", day: str = "cal_date") -> DataFrame:
    """Days present per (exchange, year) against the length of the year."""
    year = F.year(day)
    return (
        cal.groupBy(exchange, year.alias("year")).agg(F.count_distinct(day).alias("n_days"))
        .withColumn("expected", F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))))
        .withColumn("complete", F.col("n_days") == F.col("expected"))
    )


def missing_exchanges(cal: DataFrame, required: Sequence[str], exchange: str = "exchange") -> DataFrame:
    """Required exchanges without a row and exchanges that should not be there."""
    present = cal.agg(F.collect_set(F.when(F.col(exchange).isin(*required), F.col(exchange))).alias("have"))
    return present.select(F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "have")).alias(exchange))


def classify_empty(
    grid: DataFrame, counts: DataFrame, scope: Sequence[str], *,
    policy: Column, day: str, today: Column, retention_months: Column, exhausted: Column,
) -> DataFrame:
    """Outcome of every expected scope: data, valid empty, gap, skipped or retry."""
    joined = grid.join(counts.select(*scope, "n"), list(scope), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stale = retention_months.isNotNull() & (F.col(day) < F.add_months(today, -retention_months))
    outcome = (
        F.when(F.col("n") > 0, "DATA")
        .when(policy == "ALLOWED", "EMPTY_VALID")
        .when(policy == "UNSUPPORTED", "SKIPPED")
        .when(policy == "FORBIDDEN", "FAILED")
        .when(F.coalesce(stale, F.lit(False)) | exhausted, "GAP")
        .otherwise("RETRY")
    )
    return joined.withColumn("outcome", outcome)


def split_rejects(df: DataFrame, reason: Column, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows under a reason expression that is NULL for clean rows."""
    tagged = df.withColumn(name, reason)
    return tagged.where(F.col(name).isNull()).drop(name), tagged.where(F.col(name).isNotNull())


def ohlc_violations(df: DataFrame) -> DataFrame:
    return df.where(ohlc_invalid())


def outside_domain(df: DataFrame, domains: Mapping[str, Sequence[object]], *, nullable: Sequence[str] = ()) -> DataFrame:
    """Rows with a code outside its list, naming the first bad column."""
    checks = []
    for column, allowed in domains.items():
        bad = ~F.col(column).isin(*allowed)
        if column not in nullable:
            bad = bad | F.col(column).isNull()
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(column)))
    return df.withColumn("bad_column", F.coalesce(*checks)).where(F.col("bad_column").isNotNull())


def allowed_anomalies(total: Column) -> Column:
    """At most 20, at least 1, otherwise 1 % of the rows rounded down."""
    share = F.floor(total.cast("decimal(20,0)") * F.lit(tt.GATE_MAX_RATIO).cast("decimal(4,2)"))
    return F.least(F.lit(tt.GATE_MAX_COUNT), F.greatest(F.lit(1), share)).cast("bigint")


def anomaly_gate(
    df: DataFrame, by: Sequence[str], issue: Column, *, counted: Column | None = None,
    total: Column | None = None,
) -> DataFrame:
    """Verdict per scope: passes with no issue, or a valid row and a bounded issue count.

    ``counted`` narrows which rows the gate looks at (reported rows may be exempt), and
    ``total`` which rows the 1 % refers to.
    """
    looked = counted if counted is not None else F.lit(True)
    base = total if total is not None else looked
    bad = F.coalesce(issue, F.lit(False))
    out = df.groupBy(*by).agg(
        F.count_if(base).alias("total"), F.count_if(looked & ~bad).alias("valid"),
        F.count_if(looked & bad).alias("issues"), F.count_if(bad).alias("reported"),
    )
    return out.withColumn("allowed", allowed_anomalies(F.col("total"))).withColumn(
        "passed", (F.col("issues") == 0) | ((F.col("valid") > 0) & (F.col("issues") <= F.col("allowed"))))


def segment_lag(
    pairs: DataFrame, by: Sequence[str], segment: Column, *, close: str, pre_close: str, other_close: str
) -> DataFrame:
    """Does a market segment's enrichment repeat the previous close?

    Needs 20 comparable rows, 20 changed rows that match, and 95 % in both ratios. ``pairs``
    is the matched join of quotes and enrichment.
    """
    comparable = segment & F.col(close).isNotNull() & F.col(pre_close).isNotNull() & F.col(other_close).isNotNull()
    same = comparable & within(other_close, pre_close)
    moved = comparable & ~within(close, pre_close)
    out = pairs.groupBy(*by).agg(
        F.count_if(comparable).alias("comparable"), F.count_if(same).alias("matches"),
        F.count_if(moved).alias("changed"), F.count_if(moved & same).alias("changed_matches"),
    )

    def share(part: str, whole: str) -> Column:
        return F.try_divide(F.col(part).cast("decimal(20,0)"), F.col(whole).cast("decimal(20,0)")) >= F.lit(
            tt.LAG_MIN_RATIO).cast("decimal(4,2)")

    lagging = (
        (F.col("comparable") >= tt.LAG_MIN_ROWS) & (F.col("changed_matches") >= tt.LAG_MIN_ROWS)
        & share("matches", "comparable") & share("changed_matches", "changed")
    )
    return out.withColumn("lagging", F.coalesce(lagging, F.lit(False)))


def row_accounting(df: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    """Rows read, written and rejected out of tagged rows."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows_read"), F.count_if(F.col(reason).isNotNull()).alias("rows_rejected"),
        F.count_if(F.col(reason).isNull()).alias("rows_written"),
    )


def enforce(check: DataFrame, message: str, *, verdict: str | None = None) -> None:
    """Fail on any violation row, or on any scope whose ``verdict`` is false (reads one row)."""
    bad = check.where(~F.col(verdict)) if verdict else check
    row = bad.limit(1).collect()
    if row:
        raise QualityError(f"{message}: {row[0].asDict()}")


def enforce_any(df: DataFrame, message: str) -> None:
    if not df.limit(1).collect():
        raise QualityError(message)
