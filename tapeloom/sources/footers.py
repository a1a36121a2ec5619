"""Facts of stored Parquet files, gathered in tasks: fields and row count from the footer, digest from bytes streamed in pieces.

Only paths go out and one row per file comes back; neither a footer nor the content of a file reaches the driver. A task holds one
footer and one piece of ``PIECE`` bytes. Files are opened by pyarrow through the file system that their scheme names.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# the helpers below travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a file that are read at once for its digest.
PIECE = 8 << 20
#: Fixed value: the footer key under which Spark keeps the schema that it wrote.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
FACTS = (
    T.StructType().add("path", "string").add("byte_size", "long").add("row_count", "long")
    .add("fields", T.ArrayType(T.StructType().add("name", "string").add("type", "string")))
    .add("sha256", "string").add("error", "string"))


def located(path: str) -> tuple[pfs.FileSystem, str]:
    """File system and place of a path as Spark writes it: file:/x, file:///x, /x, hdfs://host/x, s3a://bucket/x."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return pfs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return pfs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if scheme == "s3a" else path)


def fields_of(file: pq.ParquetFile) -> list[dict[str, str]]:
    """Names and Spark types of a file: as its writer noted them, else as Spark would infer them (INT96 is an instant)."""
    noted = (file.metadata.metadata or {}).get(SPARK_SCHEMA)
    if noted:
        schema = T.StructType.fromJson(json.loads(noted))
    else:
        schema = from_arrow_schema(file.schema_arrow, prefer_timestamp_ntz=True)
    columns = [file.schema.column(i) for i in range(len(file.schema))]
    instants = {c.path for c in columns if c.physical_type == "INT96"}
    return [{"name": f.name, "type": "timestamp" if f.name in instants else f.dataType.simpleString()} for f in schema]


def facts_of(path: str, digest: bool) -> dict[str, object]:
    """One row of ``FACTS``. What is no readable Parquet file has an error and no fields; a file that is not there raises."""
    system, place = located(path)
    found: dict[str, object] = {"path": path}
    with system.open_input_file(place) as source:
        found["byte_size"] = source.size()
        if digest:
            sha = hashlib.sha256()
            while piece := source.read(PIECE):
                sha.update(piece)
            found["sha256"] = sha.hexdigest()
        try:
            file = pq.ParquetFile(source)
            found |= {"row_count": file.metadata.num_rows, "fields": fields_of(file)}
        except (pa.ArrowException, TypeError, ValueError) as error:  # TypeError: a type that Spark does not have
            found["error"] = f"{type(error).__name__}: {error}"[:500]
    return found


def file_facts(paths: DataFrame, *, digest: bool = False, tasks: int | None = None) -> DataFrame:
    """``FACTS`` of every file of the ``path`` column; files are spread over ``tasks`` tasks (default: four a core)."""
    schema = to_arrow_schema(FACTS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([facts_of(path, digest)], schema=schema)

    tasks = tasks or 4 * paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(tasks).mapInArrow(gather, FACTS)


def stored_files(df: DataFrame) -> list[str]:
    """Files of a scan, as plain paths (Spark lists them URL-encoded)."""
    return [unquote(f) for f in df.inputFiles()]


def drift(facts: DataFrame, declared: T.StructType) -> DataFrame:
    """``facts`` with what differs from the declaration: arrays ``missing``, ``extra``, ``retyped``, flags ``turned`` (shared names
    in another order) and ``drifted`` (any of these, or unreadable)."""
    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    wanted = [f"{f.name}:{f.dataType.simpleString()}" for f in declared]
    want, have = names(declared.fieldNames()), F.coalesce(F.col("fields.name"), names([]))
    known = F.filter("fields", lambda f: F.array_contains(want, f["name"])
                     & ~F.array_contains(names(wanted), F.concat(f["name"], F.lit(":"), f["type"])))
    out = facts.withColumns({
        "missing": F.array_except(want, have), "extra": F.array_except(have, want),
        "retyped": F.coalesce(F.transform(known, lambda f: f["name"]), names([])),
        "turned": F.array_intersect(have, want) != F.array_intersect(want, have)})
    odd = F.col("error").isNotNull() | F.col("turned")
    for part in ("missing", "extra", "retyped"):
        odd |= F.size(part) > 0
    return out.withColumn("drifted", odd)
