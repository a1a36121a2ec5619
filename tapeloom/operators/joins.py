"""Coverage, enrichment, membership and consistency joins.

No side is force-broadcast: Spark broadcasts only what its own size check allows
(spark.sql.autoBroadcastJoinThreshold) and otherwise sort-merges, where AQE splits hot
partitions. The side looked up is always unique on the join key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import types as tt
from tapeloom.functions.scalar import within
from tapeloom.operators.ranking import top_k_per_key


def uncovered(required: DataFrame, superset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys the superset does not hold; must be empty before the inner join."""
    return required.select(*keys).distinct().join(superset.select(*keys), list(keys), "left_anti")


def covered_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inner enrichment once coverage has been checked."""
    return left.join(right.select(*keys, *columns), list(keys))


def tolerant_enrich(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *,
    left_close: str, right_close: str, columns: Sequence[str],
    tolerance: str = tt.PRICE_TOLERANCE, isolate: Column | None = None, reason: str = "enrich_issue",
) -> DataFrame:
    """Left join whose right columns are accepted only when both closes agree.

    ``isolate`` (for example a lagging market segment) rejects the right side outright. The
    reason column tells why a row was left without enrichment.
    """
    side = right.select(*keys, F.col(right_close).alias("_rc"), F.lit(True).alias("_hit"),
                        *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.join(side, list(keys), "left")
    why = F.when(F.coalesce(isolate, F.lit(False)), "segment_lag") if isolate is not None else F.when(F.lit(False), "")
    why = (
        why.when(F.col("_hit").isNull(), "missing")
        .when(F.col("_rc").isNull(), "close_missing")
        .when(~within(left_close, "_rc", tolerance), "close_mismatch")
    )
    out = joined.withColumn(reason, why)
    picked = {c: F.when(F.col(reason).isNull(), F.col(f"_r_{c}")) for c in columns}
    return out.withColumns(picked).drop("_rc", "_hit", *[f"_r_{c}" for c in columns])


def extra_keys(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right keys without a left row."""
    return right.select(*keys).distinct().join(left.select(*keys), list(keys), "left_anti")


def optional_enrich(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys, *columns), list(keys), "left")


def in_master(
    df: DataFrame, master: DataFrame, mapping: Mapping[str, str], *, exclude: Column | None = None
) -> DataFrame:
    """Rows whose code is in a master table; ``mapping`` is {df column: master column}."""
    listed = master.where(~exclude) if exclude is not None else master
    side = listed.select(*[F.col(m).alias(f"_m_{c}") for c, m in mapping.items()])
    cond = [F.col(c) == F.col(f"_m_{c}") for c in mapping]
    return df.join(side, cond, "left_semi")


def not_in_master(
    df: DataFrame, master: DataFrame, mapping: Mapping[str, str], *, exclude: Column | None = None
) -> DataFrame:
    listed = master.where(~exclude) if exclude is not None else master
    side = listed.select(*[F.col(m).alias(f"_m_{c}") for c, m in mapping.items()])
    cond = [F.col(c) == F.col(f"_m_{c}") for c in mapping]
    return df.join(side, cond, "left_anti")


def in_both_masters(
    edges: DataFrame, topics: DataFrame, members: DataFrame, *,
    topic: Mapping[str, str], member: Mapping[str, str],
) -> DataFrame:
    """Edges whose topic and member are both known."""
    return in_master(in_master(edges, topics, topic), members, member)


def reject_report(rejected: DataFrame, code: str, examples: int = 5) -> DataFrame:
    """Reject count and the first codes, bounded before they are collected."""
    codes = rejected.select(code).distinct().orderBy(code).limit(examples)
    sample = codes.agg(F.array_sort(F.collect_list(code)).alias("e"))
    return rejected.agg(F.count("*").alias("rejected")).withColumn(
        "examples", F.concat_ws(",", sample.scalar())
    )


def inconsistent(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str,
    tolerance: str = tt.PRICE_TOLERANCE,
) -> DataFrame:
    """Matched rows whose values differ; a NULL source value passes."""
    a = left.select(*keys, F.col(left_value).alias("left_value"))
    b = right.select(*keys, F.col(right_value).alias("right_value")).where(F.col("right_value").isNotNull())
    return a.join(b, list(keys)).where(~within("left_value", "right_value", tolerance))


def null_safe(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Join that treats NULL scope parts as equal; right columns must not clash."""
    cond = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    return left.join(right, cond, how)


def recovered(
    failures: DataFrame, successes: DataFrame, scope: Sequence[str], *,
    failed_at: str, success_at: str, flag: str = "recovered",
) -> DataFrame:
    """Flag failures followed by a later success of the same scope.

    EXISTS(success_at > failed_at) is the same as max(success_at) > failed_at, so the
    inequality never becomes a join condition.
    """
    newest = successes.groupBy(*scope).agg(F.max(success_at).alias("_newest"))
    return (
        failures.join(newest, list(scope), "left")
        .withColumn(flag, F.coalesce(F.col("_newest") > F.col(failed_at), F.lit(False)))
        .drop("_newest")
    )


def orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children whose parent row is missing on all keys."""
    return children.join(parents.select(*keys), list(keys), "left_anti")


def parents_with_child(
    parents: DataFrame, children: DataFrame, key: str, child_pred: Column, parent_pred: Column
) -> DataFrame:
    """Parents matching a predicate themselves or through any child row."""
    hit = children.where(child_pred).select(key).distinct().withColumn("_hit", F.lit(True))
    return parents.join(hit, key, "left").where(parent_pred | F.col("_hit").isNotNull()).drop("_hit")


def registry_metrics(
    registry: DataFrame, observed: DataFrame, key: str, zero_fill: Sequence[str]
) -> DataFrame:
    """Every registered name, with zero counts where nothing was observed."""
    out = registry.join(observed, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero_fill})


def examples_per_key(df: DataFrame, keys: Sequence[str], value: str, k: int = 5) -> DataFrame:
    """First ``k`` distinct values per key plus the distinct count."""
    distinct = df.select(*keys, value).distinct()
    counts = distinct.groupBy(*keys).agg(F.count("*").alias("n"))
    sample = (
        top_k_per_key(distinct, keys, [F.col(value).asc()], k)
        .groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_list(value))).alias("examples"))
    )
    return counts.join(sample, list(keys))
