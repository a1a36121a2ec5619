"""Publishing: target + stage -> new target, the release log, and versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import types as tt
from tapeloom.functions.scalar import within
from tapeloom.operators.ranking import latest_per_key


def stamp(df: DataFrame, at: Column, column: str = "synced_at") -> DataFrame:
    return df.withColumn(column, at)


def upsert(target: DataFrame, stage: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Insert or update by key, never delete.

    ``update=None`` replaces all columns that the stage has (columns only the target has keep their values, and are NULL
    in new rows); a list updates those columns only; an empty list inserts new keys and leaves existing rows alone.
    """
    keys = list(keys)
    if update is None and set(target.columns) - set(stage.columns):
        update = [c for c in stage.columns if c not in keys]
    new_keys = stage.join(target.select(*keys), keys, "left_anti")
    if update is None:
        return target.join(stage.select(*keys), keys, "left_anti").select(*target.columns).unionByName(stage)
    if not update:
        return target.unionByName(new_keys, allowMissingColumns=True)
    return patch_columns(target, stage, keys, update).unionByName(new_keys, allowMissingColumns=True)


def patch_columns(target: DataFrame, stage: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Overwrite listed columns on existing keys; a key that the stage repeats is an error, raised when rows are made."""
    side = stage.groupBy(*keys).agg(F.count("*").alias("_hits"), F.first(F.struct(*update)).alias("_stage"))
    joined = target.join(side, list(keys), "left")
    repeated = F.raise_error(F.lit("a staged key is repeated"))
    picked = {c: F.when(F.col("_hits") > 1, repeated.cast(target.schema[c].dataType)).when(F.col("_hits") == 1, F.col(f"_stage.{c}")).otherwise(F.col(c)) for c in update}
    return joined.withColumns(picked).select(*target.columns)


def unpatched(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged keys the target does not hold; a patch needs none."""
    return stage.select(*keys).join(target.select(*keys), list(keys), "left_anti")


def replace_slice(target: DataFrame, stage: DataFrame, slice_: Column) -> DataFrame:
    """Delete a slice, insert the stage; an empty stage clears the slice."""
    return target.where(~F.coalesce(slice_, F.lit(False))).unionByName(stage)


def replace_dates(target: DataFrame, stage: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """Set-wise date replace for every date being published."""
    return target.join(dates.select(day).distinct(), day, "left_anti").select(*target.columns).unionByName(stage)


def replace_month(target: DataFrame, stage: DataFrame, entity: str, day: str) -> DataFrame:
    """Replace the staged months of the staged entities only."""
    month = F.trunc(day, "MM")
    touched = stage.select(entity, month.alias("_month")).distinct()
    kept = target.withColumn("_month", month).join(touched, [entity, "_month"], "left_anti")
    return kept.select(*target.columns).unionByName(stage)


def drop_stale(parents: DataFrame, day: str, synced: str = "synced_at", *, within: Sequence[str] = ()) -> DataFrame:
    """Remove parents of a date that the date's latest sync did not refresh; ``within`` names columns (such as the source)
    whose values are synchronised on their own, so that one source's sync leaves the others' parents alone."""
    scope = [*within, day]
    newest = parents.groupBy(*scope).agg(F.max(synced).alias(synced))
    return parents.join(newest, [*scope, synced], "left_semi").select(*parents.columns)


def carry_over(
    fresh: DataFrame, previous: DataFrame, keys: Sequence[str], columns: Sequence[str], *,
    valid_dates: DataFrame | None = None, day: str = "trade_date",
) -> DataFrame:
    """Keep patched columns of the previous version where prices did not move.

    ``valid_dates`` lists dates whose patch was computed against the current core version.
    """
    old = previous.select(*keys, F.col("close").alias("_oc"), F.col("pre_close").alias("_op"),
                          *[F.col(c).alias(f"_o_{c}") for c in columns])
    if valid_dates is not None:
        old = old.join(valid_dates.select(day).distinct(), day, "left_semi")
    joined = fresh.join(old, list(keys), "left")
    same = F.coalesce(
        within("close", "_oc", tt.PRICE_TOLERANCE) & within("pre_close", "_op", tt.PRICE_TOLERANCE), F.lit(False))
    out = joined.withColumns({c: F.when(same, F.col(f"_o_{c}")) for c in columns})
    return out.drop("_oc", "_op", *[f"_o_{c}" for c in columns])


# ---------------------------------------------------------------- release log

RELEASE_KEY = ("dataset", "scope_type", "scope_key")


def current_releases(log: DataFrame, keys: Sequence[str] = RELEASE_KEY, version: str = "version") -> DataFrame:
    """Newest row per scope of the append-only release log."""
    return latest_per_key(log, keys, [F.col("published_at").desc_nulls_last(), F.col(version).desc_nulls_last()])


def release_row(spark: SparkSession, dataset: str, scope_type: str, scope_key: str, version: str, rows: int) -> DataFrame:
    return spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.lit(scope_type).alias("scope_type"), F.lit(scope_key).alias("scope_key"),
        F.lit(version).alias("version"), F.lit(rows).cast("bigint").alias("row_count"),
        F.current_timestamp().alias("published_at"),
    )


class VersionedTable:
    """Plain-Parquet table whose scopes are written as versions and made visible by a pointer.

    ``root/data/scope_key=…/version=…`` holds rows, ``root/_releases`` the pointers. The
    pointer row is appended last, so a half-written version is never read; an empty stage
    publishes a version without rows, which clears the scope.
    """

    def __init__(self, spark: SparkSession, root: str, dataset: str, scope_type: str = "DATE") -> None:
        self.spark, self.root, self.dataset, self.scope_type = spark, root, dataset, scope_type

    @property
    def log_path(self) -> str:
        return f"{self.root}/_releases"

    def publish(self, stage: DataFrame, scope_key: str, version: str) -> int:
        path = f"{self.root}/data/scope_key={scope_key}/version={version}"
        stage.write.mode("overwrite").option("compression", "zstd").parquet(path)
        rows = self.spark.read.schema(stage.schema).parquet(path).count()
        release_row(self.spark, self.dataset, self.scope_type, scope_key, version, rows).coalesce(1).write.mode(
            "append").parquet(self.log_path)
        return rows

    def publish_scopes(self, stage: DataFrame, scope: Column, version: str, scopes: DataFrame | None = None) -> None:
        """Publish every scope of the stage in one job, then all their pointers in one append.

        ``scopes`` (scope_key) names scopes to release even when the stage has no row for
        them, which clears them. REBALANCE keeps one scope in few files and splits a hot one
        over several tasks.
        """
        tagged = stage.withColumn("scope_key", scope).withColumn("version", F.lit(version))
        tagged.hint("rebalance", "scope_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd").partitionBy("scope_key", "version").parquet(f"{self.root}/data")
        written = self._data(stage.schema).where(F.col("version") == version)
        pointers = written.groupBy("scope_key").agg(F.count("*").alias("row_count"))
        if scopes is not None:
            pointers = scopes.select("scope_key").distinct().join(pointers, "scope_key", "left")
        pointers.select(
            F.lit(self.dataset).alias("dataset"), F.lit(self.scope_type).alias("scope_type"), "scope_key",
            F.lit(version).alias("version"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.current_timestamp().alias("published_at"),
        ).coalesce(1).write.mode("append").parquet(self.log_path)

    def _data(self, schema: T.StructType | None = None) -> DataFrame:
        """All versions. Folder names are read as text, so 001 stays 001."""
        path = f"{self.root}/data"
        folders = ("scope_key", "version")
        body = [f for f in (schema or self.spark.read.parquet(path).schema) if f.name not in folders]
        return self.spark.read.schema(T.StructType([*body, *[T.StructField(n, T.StringType()) for n in folders]])).parquet(path)

    def exists(self) -> bool:
        """Has anything been published yet?"""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def releases(self, without: str | None = None) -> DataFrame:
        """Newest pointer of every scope, as if the version ``without`` had not been published."""
        log = self.spark.read.parquet(self.log_path)
        return current_releases(log if without is None else log.where(F.col("version") != without))

    def read(self, *, without: str | None = None, scopes: DataFrame | None = None) -> DataFrame:
        """Rows of the newest version of every scope, or of the ``scopes`` (scope_key) only."""
        newest = self.releases(without).select("scope_key", "version")
        if scopes is not None:
            newest = newest.join(scopes.select("scope_key").distinct(), "scope_key", "left_semi")
        return self._data().join(newest, ["scope_key", "version"], "left_semi")


def stale_lineage(
    releases: DataFrame, lineage: DataFrame, *, dependent: str, upstream: str,
) -> DataFrame:
    """Scopes whose dependent release was computed against a superseded upstream version.

    ``lineage`` holds (dataset, scope_key, version, upstream, upstream_version).
    """
    current = current_releases(releases).select("dataset", "scope_key", "version")
    dep = current.where(F.col("dataset") == dependent).select("scope_key", F.col("version").alias("dep_version"))
    up = current.where(F.col("dataset") == upstream).select("scope_key", F.col("version").alias("up_version"))
    used = lineage.where((F.col("dataset") == dependent) & (F.col("upstream") == upstream)).select(
        "scope_key", F.col("version").alias("dep_version"), "upstream_version")
    return dep.join(up, "scope_key").join(used, ["scope_key", "dep_version"], "left").withColumn(
        "stale", ~F.col("upstream_version").eqNullSafe(F.col("up_version")))
