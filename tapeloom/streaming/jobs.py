"""Streaming forms of the incremental intents: publish, quota, re-delivery, snapshots.

The transformations are the batch ones; only sources, watermarks and sinks differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapeloom.operators.publish import VersionedTable
from tapeloom.operators.ranking import latest_per_key


def landing(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """Stream of newly landed Parquet assets with a declared schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def newest_revision(rows: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Late or repeated deliveries: the highest revision of each key wins."""
    return latest_per_key(rows, list(keys), [F.col(revision).desc()])


def batch_version(batch: DataFrame, batch_id: int) -> str:
    """Version of a micro-batch: its id and the stream's, which a new checkpoint changes and a restart keeps."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{batch_id:012d}" if stream is None else f"{batch_id:012d}.{stream}"


def merge_into(
    table: VersionedTable, scope: Column, merge: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that merges a micro-batch with the current rows of the scopes it touches.

    The version names the stream and the batch. Current rows are read as if that version had not been published, so a replayed batch
    starts from the same rows and overwrites its own folders: a restart neither loses nor doubles rows, and a stream that begins
    anew with another checkpoint builds on what is published. A scope may arrive in any number of micro-batches; scopes
    that a batch does not touch are neither read nor written. One stream at a time may write to a table.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_version(batch, batch_id)
        stage = prepare(batch).persist()
        try:
            if stage.isEmpty():
                return
            rows = stage
            if table.exists():
                touched = stage.select(scope.alias("scope_key")).distinct()
                rows = table.read(without=version, scopes=touched).select(*stage.columns).unionByName(stage)
            table.publish_scopes(merge(rows), scope, version)
        finally:
            stage.unpersist()

    return apply


def publish_stream(
    stream: DataFrame, table: VersionedTable, prepare: Callable[[DataFrame], DataFrame], scope: Column, checkpoint: str, *,
    keys: Sequence[str], revision: str,
) -> StreamingQuery:
    """Validate every micro-batch with ``prepare`` and merge it into the published scopes, newest revision of each key."""
    handler = merge_into(table, scope, lambda rows: newest_revision(rows, keys, revision), prepare)
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota_windows(requests: DataFrame, width: str, *, slide: str | None = None, at: str = "requested_at") -> DataFrame:
    """Requests, delayed requests and successes per endpoint and time window (batch or stream)."""
    frame = F.window(at, width, slide) if slide else F.window(at, width)
    out = requests.groupBy("endpoint", frame.alias("w")).agg(
        F.count("*").alias("used"), F.count_if(F.col("wait_ms") > 0).alias("delayed"),
        F.count_if(F.col("status") == "SUCCESS").alias("success"))
    return out.select("endpoint", F.col("w.start").alias("window_start"), "used", "delayed", "success")


def quota_stream(requests: DataFrame, width: str, lateness: str, *, slide: str | None = None) -> DataFrame:
    """The windows as a stream; in update mode a window's newest row has its largest ``used``."""
    return quota_windows(requests.withWatermark("requested_at", lateness), width, slide=slide)


def quota_sums(table: VersionedTable, width: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler adding each micro-batch's window counts to the published ones; no row is too late to count."""
    def add(rows: DataFrame) -> DataFrame:
        return rows.groupBy("endpoint", "window_start").agg(*[F.sum(c).alias(c) for c in ("used", "delayed", "success")])
    return merge_into(table, F.date_format("window_start", "yyyy-MM-dd"), add, lambda batch: quota_windows(batch, width))


def first_delivery(stream: DataFrame, keys: Sequence[str], at: str, lateness: str) -> DataFrame:
    """Drop rows re-delivered on their natural key within the lateness bound.

    A first delivery that comes later than the bound is dropped as well, so this is for feeds that arrive in the order of ``at``;
    ``first_delivery_into`` keeps them whatever their order.
    """
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def first_delivery_into(
    table: VersionedTable, bloom: VersionedTable, scope: Column, keys: Sequence[str], *, bits: int = 1 << 23, hashes: int = 5,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that appends rows whose key was never published, however long ago the first delivery was.

    It needs no watermark, so no row is too late and files may come in any order. A Bloom filter of all published keys
    passes most new keys without touching the table; what it may contain is compared exactly with the keys of the scopes
    concerned (``scope`` must follow from the keys). The filter is a table of ``bits`` / 64 words at most, which is also what the
    driver holds; it is only ever added to, so a replayed batch leaves it as it was. When it fills up, more rows are compared.
    """
    names = list(keys)

    def places(rows: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), *names), F.lit(bits)) for i in range(hashes)])).alias("place")
        return rows.select(each).select(F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int)) AS held"))

    remember = merge_into(bloom, (F.col("word") % 64).cast("string"), lambda rows: rows.groupBy("word").agg(F.bit_or("held").alias("held")), places)
    append = merge_into(table, scope, lambda rows: rows)

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_version(batch, batch_id)
        new = batch.dropDuplicates(names)
        if table.exists():
            known = np.zeros(bits // 64 + 1, "int64")
            for row in bloom.read().select("word", "held").collect():  # bits / 64 rows at most
                known[row["word"]] = row["held"]
            held = batch.sparkSession.sparkContext.broadcast(known)

            @F.pandas_udf("boolean")
            def seen(place: pd.Series) -> pd.Series:
                return pd.Series((held.value[place // 64].view("uint64") >> (place % 64).to_numpy("uint64")) & np.uint64(1) == 1)

            maybe = reduce(lambda x, y: x & y, [seen(F.pmod(F.xxhash64(F.lit(i), *names), F.lit(bits))) for i in range(hashes)])
            marked = new.withColumn("_maybe", maybe).persist()
            doubtful = marked.where("_maybe").drop("_maybe")
            before = table.read(without=version, scopes=doubtful.select(scope.alias("scope_key")).distinct()).select(*names)
            new = marked.where("NOT _maybe").drop("_maybe").unionByName(doubtful.join(before, names, "left_anti"))
        append(new, batch_id)
        remember(new, batch_id)

    return apply


def snapshot_sizes_stream(feed: DataFrame, scope: Sequence[str], captured: str, lateness: str, width: str = "1 minute") -> DataFrame:
    """Closed capture windows with their size; append mode emits each once."""
    return (
        feed.withWatermark(captured, lateness).groupBy(*scope, F.window(captured, width).alias("w"))
        .agg(F.count("*").alias("n")).select(*scope, F.col("w.start").alias("captured"), "n")
    )


def latest_complete(sizes: DataFrame, scope: Sequence[str], captured: str, size: str) -> DataFrame:
    """Newest capture among the largest, per scope."""
    best = sizes.groupBy(*scope).agg(F.max(F.struct(size, captured)).alias("_b"))
    return best.select(*scope, F.col(f"_b.{size}").alias(size), F.col(f"_b.{captured}").alias(captured))


def snapshot_state(table: VersionedTable, scope: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler keeping the running latest complete capture per scope."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in scope])
    return merge_into(table, key, lambda rows: latest_complete(rows, scope, "captured", "n").select(*rows.columns))
