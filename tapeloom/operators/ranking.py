"""Latest-row, top-k, grouping and paging operators.

Per-key limits are written as ``row_number() <= k``: Spark turns them into a
WindowGroupLimit that trims each key to k rows before the shuffle, so a key holding a
third of the rows reaches its reducer as k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.errors import QueryError

def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_as: str | None = None
) -> DataFrame:
    """First ``k`` rows of each key in the given order, for any ``k``.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows Spark trims before the shuffle; beyond it the
    result is the same without the trim.
    """
    if k < 1:
        raise QueryError("INVALID_REQUEST", "k must be at least 1")
    name = rank_as or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank_as else kept.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key."""
    return top_k_per_key(df, keys, order, 1)


def descending(column: Column) -> Column:
    """Ascending sort key equal to a descending order on a number or timestamp, NULLs last."""
    return F.struct(column.isNull().alias("n"), (-column).alias("v"))


def micros(column: Column | str) -> Column:
    """Timestamp as microseconds, so it can be negated or subtracted."""
    col = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(col.cast("timestamp"))


def representative(
    df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str], count_as: str
) -> DataFrame:
    """Group size plus the row with the smallest ``order``, in one partial aggregation."""
    best = F.min_by(F.struct(*columns), order)
    out = df.groupBy(*keys).agg(F.count("*").alias(count_as), best.alias("_best"))
    return out.select(*keys, count_as, *[F.col(f"_best.{c}").alias(c) for c in columns])


def mark_first(df: DataFrame, keys: Sequence[str], order: Column, flag: str = "is_first") -> DataFrame:
    """Flag the first row of each key; all other rows are superseded duplicates.

    ``order`` must be unique inside a key. The winner per key is one row, so the join side
    is unique and AQE can split a hot key on the other side.
    """
    tagged = df.withColumn("_o", order)
    best = tagged.groupBy(*keys).agg(F.min("_o").alias("_best"))
    return tagged.join(best, list(keys)).withColumn(flag, F.col("_o") == F.col("_best")).drop("_o", "_best")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, total_as: str = "total") -> DataFrame:
    """One page plus the total row count.

    The total is a scalar subquery over a partial count, not an unpartitioned window.
    """
    if offset < 0 or limit < 1:
        raise QueryError("INVALID_REQUEST", "bad page bounds")
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn(total_as, total)


def page_or_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Page and total as separate frames, for pages past the end."""
    return page(df, order, offset, limit), df.agg(F.count("*").alias("total"))


def top_k_or_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """First ``k`` rows of each key, or all rows."""
    return df if k is None else top_k_per_key(df, keys, order, k)


def row_limit(limit: int | None, most: int, *, single: bool) -> int | None:
    """The limit of a question: within 1..``most`` for one subject, as its contract has it; any number of 1 or more, or
    None for all rows, where it applies to every subject of a whole table."""
    if limit is None:
        return None
    if single:
        return clamp(limit, 1, most)
    if limit < 1:
        raise QueryError("INVALID_REQUEST", "limit must be at least 1")
    return limit


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def freshest(
    candidates: DataFrame, inputs: DataFrame, scope: Sequence[str], key: str,
    *, input_time: str, candidate_time: str,
) -> DataFrame:
    """Per scope the candidate with the newest input.

    Order: has any input, newest input time, own time, id; all descending.
    """
    newest = inputs.groupBy(key).agg(F.max(input_time).alias("_input_at"))
    joined = candidates.join(newest, key, "left")
    rank = F.struct(
        F.col("_input_at").isNotNull().alias("h"), F.col("_input_at").alias("i"),
        F.col(candidate_time).alias("c"), F.col(key).alias("k"),
    )
    return joined.groupBy(*scope).agg(
        F.max_by(key, rank).alias(key), F.max_by("_input_at", rank).alias("input_at")
    )
