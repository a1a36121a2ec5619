"""Web archives with a capture index: WARC records written by Spark's text writer, read back, and merged into one index.

Method (external index merge): every archive file yields a *run* of index rows sorted by URL key, capture time and page. The
runs are written, cut into key ranges that spread hot URLs over several ranges, and in each range the pieces of all runs are
merged k-way by a loser tree; the ranges in order are one capture history.

Records: pages with equal payloads of ``REVISIT_BYTES`` or more are revisits of the one with the largest page_id. The response
is found by an aggregation with map-side combine and a join that AQE splits for a hot payload. A WARC record ends
with two line ends, which is the line separator the writer is given; it commits files as any Spark write does, so lost
executors leave nothing half done. Files are gzip streams of at most ``RECORDS_PER_FILE`` records; offsets in the index
count uncompressed bytes. Content-Length alone decides where a record ends, so payloads may hold anything.

Defined cases: null html is an empty payload; a null url has no Target-URI and an empty key; a null page_id is written as
``null``, is never the response while a page with an id has the payload, and comes first among equal keys; repeated rows are a
record each (with the largest page_id, each a response); blanks and control characters of a url are written as %20; an empty table
gives no rows; further columns are not archived. Without a time column, or where it is null, the capture time is made up from the page_id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import quoted, shared_path, store

REVISIT_BYTES, RECORDS_PER_FILE = 1000, 4000
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200  # 2024-01-01, the capture time of page 0 where pages carry no time
MADE_UP = 253_402_300_800 - EPOCH  # seconds from there to the end of the year 9999, the last one that a WARC-Date can write

INDEX = [("url_key", "string"), ("captured_at", "string"), ("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"),
         ("record_type", "string"), ("refers_to", "long"), ("file", "string"), ("offset", "long"), ("record_bytes", "long")]
INDEX_DDL = ", ".join(f"{n} {t}" for n, t in INDEX)
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in INDEX])


def capture_date(page: Column, taken: Column | None) -> Column:
    """WARC-Date: the given time in UTC (a timestamp without zone is taken as UTC), else EPOCH and page_id seconds."""
    made_up = F.lit(EPOCH) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(MADE_UP))
    seconds = F.convert_timezone(None, F.lit("UTC"), F.timestamp_seconds(made_up).cast("timestamp_ntz"))
    if taken is None:
        return F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.date_format(F.coalesce(taken, seconds), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured_at: str | None = None) -> DataFrame:
    """One column ``value``: a WARC record per page, without its closing line ends. ``captured_at`` names a timestamp column."""
    taken = None
    if captured_at is not None:
        taken = F.col(quoted(captured_at))
        if not isinstance(pages.select(taken).schema[0].dataType, T.TimestampNTZType):
            taken = F.convert_timezone(None, F.lit("UTC"), taken.cast("timestamp").cast("timestamp_ntz"))
    page, body = F.col(quoted(page_id)), F.coalesce(F.col(quoted(html)), F.lit(""))
    rows = pages.select(page.cast("long").alias("page"), capture_date(page.cast("long"), taken).alias("date"), F.col(quoted(url)).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("digest"))
    key = F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page").cast("string"), F.lit("null"))))
    rows = rows.withColumn("key", key)
    best = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("key").agg(F.max("page").alias("best"))
    rows = rows.join(best, "key", "left")
    revisit = F.col("best").isNotNull() & ~F.col("page").eqNullSafe(F.col("best"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))

    def urn(column):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))

    def line(name: str, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page"))), line("WARC-Date", F.col("date")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("best"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Write the pages as WARC files into a new folder."""
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query; without scheme, user, port, leading www and fragment."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = cut + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield at, stop - at, headers, data[cut + 4 : stop]
        at = stop + 4


def inflate(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "null" else int(number)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives, one sorted run per file; response payloads are checked against their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, size, headers, block in parse(inflate(content.as_py())):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of the record at byte {at} is not what was written")
                    rows.append((url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"],
                                 _page(headers["WARC-Refers-To"]) if revisit else None, name.as_py(), at, size))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW.field(i).type) for i in range(len(INDEX))], schema=_ARROW)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX_DDL)


def loser_tree_merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) in key order over sorted lists of keys; equal keys come in the order of the runs."""
    k = len(runs)
    done = object()
    places = [0] * k

    def head(i: int):
        return runs[i][places[i]] if places[i] < len(runs[i]) else done
    heads = [head(i) for i in range(k)]

    def before(i: int, j: int) -> bool:
        a, b = heads[i], heads[j]
        if a is done or b is done:
            return b is done and (a is not done or i < j)
        return a < b or (a == b and i < j)
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not done:
        yield best, places[best]
        places[best] += 1
        heads[best] = head(best)
        node = (best + k) // 2
        while node:
            if before(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """Index rows in one order over all partitions: by url_key, captured_at and page_id."""
    order = ["url_key", "captured_at", "page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        files = rows.column("file").to_pylist()
        keys = [(u, t, p is not None, p or 0) for u, t, p in zip(*(rows.column(c).to_pylist() for c in order), strict=True)]
        starts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
        pieces = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(files)], strict=True)]
        yield from rows.take(pa.array([starts[i] + j for i, j in loser_tree_merge(pieces)], pa.int64())).combine_chunks().to_batches()
    ranged = runs.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions("file", *[F.col(c).asc_nulls_first() for c in order])
    return ranged.mapInArrow(run, INDEX_DDL)


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write the pages, read the archives back and return the merged index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, **columns)
    return merge_runs(store(read_archives(spark, path), "index-runs"))
