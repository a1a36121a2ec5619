"""A stored copy of a table with a row id and compressed texts, for operators that come back to the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import free_name, map_arrow, store


def pack(docs: DataFrame, text: str, name: str) -> tuple[DataFrame, str]:
    """(table, row id column): all columns, ``text`` as zstd bytes (null stays null), and an id that is unique and fixed.

    Written once, so that ids stay the same however often the table is read; a shuffle of it moves compressed texts.
    """
    rid = free_name(docs.columns, "row_id")
    place, names = docs.columns.index(text), [*docs.columns, rid]
    fields = [T.StructField(f.name, T.BinaryType()) if i == place else f for i, f in enumerate(docs.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([None if x is None else squeeze(x.encode()) for x in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == place else batch.column(i) for i in range(len(names))], names=names)
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    return store(map_arrow(numbered, run, T.StructType([*fields, T.StructField(rid, T.LongType())])), name), rid


def unpack(column: pa.Array) -> list[bytes | None]:
    """The texts of a packed column as UTF-8 bytes."""
    expand = zstandard.ZstdDecompressor().decompress
    return [None if x is None else expand(x) for x in column.to_pylist()]


def as_text(raw: list[bytes | None]) -> pa.Array:
    """UTF-8 bytes as an Arrow string column that keeps its place for nulls (as empty texts)."""
    return pa.array([x or b"" for x in raw], pa.large_binary()).cast(pa.large_string())
