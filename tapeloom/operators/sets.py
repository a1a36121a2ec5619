"""Unions, differences and scope overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL by column name with a discriminator; absent columns become NULL."""
    tagged = [df.select(F.lit(name).alias(tag), "*") for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def missing_from(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` whose key is absent from ``present``."""
    return expected.join(present.select(*keys), list(keys), "left_anti")


def one_sided(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    *, left_label: str = "left_only", right_label: str = "right_only",
) -> DataFrame:
    """Keys found on one side only, with a label.

    Each side is first reduced to distinct keys (a map-side combine), so hot keys cost one
    row per task in the shuffle.
    """
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return missing_from(a, b, keys).withColumn("side", F.lit(left_label)).unionByName(
        missing_from(b, a, keys).withColumn("side", F.lit(right_label))
    )


def override_merge(
    current: DataFrame, prior: DataFrame, scope: Sequence[str], *, fallback: bool = True
) -> DataFrame:
    """Scopes of the current batch win; the others fall back to the prior assets."""
    if not fallback:
        return current
    covered = current.select(*scope).distinct()
    return current.unionByName(prior.join(covered, list(scope), "left_anti"))


def distinct_codes(*frames: DataFrame, column: str = "code") -> DataFrame:
    """Union-distinct of one column over several masters."""
    return reduce(lambda a, b: a.union(b), [f.select(column) for f in frames]).distinct()
