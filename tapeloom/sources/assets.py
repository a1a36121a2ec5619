"""Raw assets: immutable Parquet files per feed and scope, read in source order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.errors import SchemaMismatch
from tapeloom.operators.sets import one_sided
from tapeloom.sources.feeds import Feed
from tapeloom.sources.footers import drift, file_facts

_SCHEME = "^[a-zA-Z0-9]+:/*"


def schema_fingerprint(schema: T.StructType) -> str:
    """Stable hash of field names, order and types, kept in the asset manifest."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)
    return hashlib.sha256(text.encode()).hexdigest()


def foreign_assets(manifest: DataFrame, declared: T.StructType) -> DataFrame:
    """Manifest rows whose recorded schema fingerprint is not the declared one."""
    return manifest.where(~F.col("fingerprint").eqNullSafe(F.lit(schema_fingerprint(declared))))


def path_key(path: str) -> str:
    """A path without its scheme and trailing slashes: file:/x and file:///x name the same file."""
    return re.sub(_SCHEME, "", path).strip("/")


def asset_of(file: str, places: dict[str, int]) -> int:
    """Rank of the longest declared path that is the file or a folder above it."""
    key = path_key(file)
    while key not in places and "/" in key:
        key = key.rsplit("/", 1)[0]
    return places.get(key, len(places))


def schema_drift(spark: SparkSession, declared: T.StructType, files: Sequence[str]) -> DataFrame:
    """Footer facts of the files and how each differs from the declared schema (see ``footers.drift``); 32 files a task."""
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    return drift(file_facts(paths, tasks=len(files) // 32 + 1), declared)


def read_assets(spark: SparkSession, declared: T.StructType, paths: Sequence[str]) -> DataFrame:
    """All assets of a feed in one scan, with ``_asset``, ``_row`` and ``_ord`` lineage.

    ``paths`` come in scope order. The footer of every file must have the declared schema; footers are read in tasks and the
    error names all files that differ (``schema_drift`` says how). ``_ord`` is a whole number (file rank, then row), so "first row wins" rules
    survive any shuffle and aggregate in hash tables; the file ranks are a table of one row per file.
    """
    scan = spark.read.schema(declared).parquet(*paths)
    frame = scan.select("*", F.col("_metadata.file_path").alias("_asset"), F.col("_metadata.row_index").alias("_row"))
    places = {path_key(p): i for i, p in enumerate(paths)}
    found = sorted(scan.inputFiles(), key=lambda f: (asset_of(unquote(f), places), f))  # URL-encoded, as is _metadata.file_path
    files = [unquote(f) for f in found]
    rank = {f: i for i, f in enumerate(files)}
    foreign = schema_drift(spark, declared, files).where("drifted").select("path", "missing", "extra", "retyped", "turned", "error").collect()
    if foreign:
        raise SchemaMismatch("; ".join(str(r.asDict()) for r in sorted(foreign, key=lambda r: rank[r["path"]])))
    ranks = spark.createDataFrame([(path_key(f), i) for i, f in enumerate(found)], "_key string, _file long")
    return (
        frame.withColumn("_key", F.regexp_replace("_asset", _SCHEME, "")).join(ranks, "_key")
        .withColumn("_ord", F.shiftleft("_file", 40) + F.col("_row")).drop("_file", "_key")
    )


def seal(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write an asset once; an existing path is an error, zero rows keep their schema."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_monthly(df: DataFrame, path: str, day: str = "trade_date", sort: str = "ts_code") -> None:
    """Lay a fact table out by month, clustered by code inside each file.

    REBALANCE lets AQE size the files: small months share a task, a huge month is split.
    """
    (
        df.withColumn("trade_month", F.trunc(day, "MM"))
        .hint("rebalance", "trade_month")
        .sortWithinPartitions("trade_month", sort)
        .write.mode("errorifexists").partitionBy("trade_month").option("compression", "zstd").parquet(path)
    )


def read_days(spark: SparkSession, path: str, start: str, end: str, day: str = "trade_date") -> DataFrame:
    """Date range of a monthly table; the derived month predicate prunes partitions."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.read.parquet(path).where(
        (F.col("trade_month") >= F.trunc(lo, "MM"))
        & (F.col("trade_month") <= F.trunc(hi, "MM"))
        & F.col(day).between(lo, hi)
    )


def asset_inventory(spark: SparkSession, glob: str, feed: Feed | None = None) -> DataFrame:
    """Path, size, SHA-256 of the bytes and row count of every stored file, and whether it has the schema of ``feed`` (None: any).

    Files are listed without their content, bytes are streamed in tasks and row counts come from the footers, so that the size
    of a file does not matter. An unreadable file has no row count.
    """
    paths = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(glob).select("path")
    )
    facts = file_facts(paths, digest=True)
    fits = F.col("error").isNull() if feed is None else ~F.col("drifted")
    facts = facts if feed is None else drift(facts, feed.schema)
    return facts.select("path", "byte_size", "sha256", "row_count", fits.alias("fits"))


def audit_assets(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored files against the manifest: problem and row count (stored, else declared) per path, clean paths omitted.

    Of several problems of a file the first counts: missing, orphan, hash, rows (a stored file without a row count is unreadable), schema.
    """
    have, want = inventory.alias("h"), manifest.alias("w")
    problem = (
        F.when(F.col("h.path").isNull(), "missing_file")
        .when(F.col("w.path").isNull(), "orphan_file")
        .when(F.col("h.sha256") != F.col("w.sha256"), "hash_mismatch")
        .when(F.col("h.row_count").isNull(), "unreadable_file")
        .when(F.col("h.row_count") != F.col("w.row_count"), "row_count_mismatch")
        .when(~F.col("h.fits"), "schema_mismatch")
    )
    return (
        have.join(want, F.col("h.path") == F.col("w.path"), "full_outer")
        .select(F.coalesce("h.path", "w.path").alias("path"), problem.alias("problem"), F.coalesce("h.row_count", "w.row_count").alias("row_count"))
        .where(F.col("problem").isNotNull())
    )


def reconcile_assets(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files without a manifest row and manifest rows without a file."""
    return one_sided(stored, manifest, ["path"], left_label="orphan_file", right_label="missing_file")
