"""Lineage as data: affected-dataset closure, dependency resolution, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.aggregates import readiness
from tapeloom.session import checkpoint_dir


def affected_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Datasets reachable from changed endpoints, with the fewest steps to each.

    Breadth-first over the dependency edges (upstream, downstream). Each round joins only
    the newly reached names and is checkpointed, so the plan stays flat and a lost executor
    costs one round; the loop ends when a round reaches nothing new.
    """
    checkpoint_dir(edges.sparkSession)
    hops = edges.select("upstream", "downstream").distinct()
    reached = seeds.select(F.col("name"), F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = reached
    depth = 0
    while True:
        depth += 1
        frontier = (
            frontier.join(hops, F.col("name") == F.col("upstream"))
            .select(F.col("downstream").alias("name")).distinct()
            .join(reached, "name", "left_anti")
            .withColumn("depth", F.lit(depth)).checkpoint()
        )
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def resolve_dependencies(dependencies: DataFrame, current: DataFrame, prior: DataFrame) -> DataFrame:
    """Status and asset of each (process, dependency).

    Current-batch assets win over the newest prior asset of the same scope; a failed
    current run without fallback is FAILED, an unfinished one WAITING, none MISSING.
    ``current``: (name, scope, asset_id, run_status); ``prior``: (name, scope, prior_id).
    """
    joined = dependencies.join(current, ["name", "scope"], "left").join(prior, ["name", "scope"], "left")
    done = F.col("run_status") == "SUCCESS"
    asset = F.when(done, F.col("asset_id")).otherwise(F.col("prior_id"))
    status = (
        F.when(asset.isNotNull(), "READY")
        .when(F.col("run_status") == "FAILED", "FAILED")
        .when(F.col("run_status").isNotNull(), "WAITING")
        .otherwise("MISSING")
    )
    return joined.withColumns({"status": status, "resolved_id": asset})


def impact(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Processes that depend on the changed runs and what they become."""
    touched = dependencies.join(changed.select(F.col("asset_id").alias("resolved_id")), "resolved_id", "left_semi")
    affected = dependencies.join(touched.select("process_id").distinct(), "process_id", "left_semi")
    return readiness(affected, "process_id")
