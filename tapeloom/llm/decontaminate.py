"""Benchmark decontamination: token windows of a corpus against a broadcast hash set of the benchmark's windows.

Method: the benchmark's normalised n-grams (10 words; a shorter item is one window) become a sorted array of hashes
that every task holds. Training texts are scanned in numpy: word hashes, rolling window hashes, binary search. Every
hit is verified against the words themselves, so a hash collision changes nothing.

Bound: the broadcast holds windows of at most ``max_bytes`` bytes (hash, words and item id of each, as flat arrays; one window more at
most if its words are longer than that). A larger benchmark is dealt into blocks by hash; the corpus is scanned once per block, one block is
broadcast at a time, and the blocks' hits are merged per document. Results are the same for any number of blocks.

Defined cases: null text has no words (not contaminated); items without words are ignored; repeated items and equal
item ids count once in ``n_items``; a null item_id is named ``null`` in the list; repeated documents are judged each on
their own; an empty benchmark or corpus gives zero hits or no rows; further columns are kept unless named as the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import free_name, map_arrow, quoted, store, without
from tapeloom.llm.wordhash import ALNUM, LOWER, Words, grams, mix, words_of

WINDOW = 10
MAX_BYTES = 64 << 20
ROW_BYTES = 24  # of a window beside its words and item: hash and two offsets

REPORT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()),
          ("contaminated", T.BooleanType())]


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, size, key, words): the windows of every benchmark item, with words joined by one space."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {"item": [], "size": [], "key": [], "words": []}
            for lo, hi, w in words_of(batch.column(1), ALNUM, LOWER):
                raw = w.data.tobytes()
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if a == b:
                        continue
                    size = min(window, b - a)
                    keys = mix(grams(w.hash[a:b], size))
                    spans = [raw[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]
                    for k in range(b - a - size + 1):
                        out["item"].append(ids[lo + i])
                        out["size"].append(size)
                        out["key"].append(int(keys[k].astype(np.int64)))
                        out["words"].append(b" ".join(spans[k : k + size]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.string()), ("size", pa.int32()), ("key", pa.int64()), ("words", pa.binary())]))
    return map_arrow(items, scan, "item string, size int, key long, words binary").distinct()


class WindowSet:
    """The windows of one block as flat arrays, by size in the order of their hashes; equal hashes follow each other."""

    def __init__(self, table: pa.Table):
        self.sizes = {}
        sizes = table.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == size)).sort_by("key").combine_chunks()
            words, items = (part.column(n).combine_chunks() if part.num_rows else part.column(n) for n in ("words", "item"))
            self.sizes[size] = (part.column("key").to_numpy(), *_flat(words), *_flat(items))

    def hits(self, w: Words) -> tuple[list[tuple[int, int]], list[tuple[int, str]]]:
        """Word ranges (start, end) of verified windows, and (text, item) pairs."""
        ranges, found = [], []
        for size, (keys, words, word_at, items, item_at) in self.sizes.items():
            have = mix(grams(w.hash, size)).view(np.int64)
            at = np.searchsorted(keys, have)
            at[at == len(keys)] = 0
            hit = np.flatnonzero((keys[at] == have) & (np.arange(len(have)) + size <= w.stop[: len(have)])) if len(have) else ()
            for i in hit:
                said = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[i : i + size], w.ends[i : i + size], strict=True))
                k, sure = int(at[i]), False
                while k < len(keys) and keys[k] == have[i]:
                    if words[word_at[k] : word_at[k + 1]] == said:
                        sure = True
                        found.append((int(w.text[i]), items[item_at[k] : item_at[k + 1]].decode()))
                    k += 1
                if sure:
                    ranges.append((int(i), int(i) + size))
        return ranges, found


def _flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The values of a binary column behind each other, and where each begins."""
    values = column.to_pylist()
    return b"".join(values), np.concatenate(([0], np.cumsum([len(x) for x in values], dtype=np.int64)))


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, window: int, max_bytes: int) -> list[DataFrame]:
    """The stored windows of the benchmark in blocks of at most ``max_bytes`` bytes."""
    named = item_windows(benchmark, window).select("size", "key", "words", F.coalesce("item", F.lit("null")).cast("binary").alias("item")).distinct()
    windows = store(named, "benchmark-windows")
    total = windows.agg(F.sum(F.length("words") + F.length("item") + ROW_BYTES)).first()[0] or 0
    parts = 1 if total <= max_bytes else -(-total * 5 // (max_bytes * 4))  # a fifth is spare, as hashes deal unevenly
    return [windows.where(F.pmod(F.xxhash64("size", "key", "item"), F.lit(parts)) == i) if parts > 1 else windows for i in range(parts)]


def _broadcast(block: DataFrame) -> Broadcast:
    return block.sparkSession.sparkContext.broadcast(WindowSet(block.toArrow()))


def _covered(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for a, b in ranges:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, max_bytes: int = MAX_BYTES, cut: bool = False) -> DataFrame:
    """Columns of ``docs`` and the report columns of each document; with ``cut`` the hit words are taken out of the text.

    Where a run of hit words goes, the separators behind it go too. Columns of ``docs`` with the report's names are replaced.
    """
    docs = without(docs, [n for n, _ in REPORT])
    blocks = _blocks(benchmark.select(F.col(quoted(item_id)).cast("string"), F.col(quoted(item_text))), window, max_bytes)
    if len(blocks) > 1:
        return _scan_blocks(docs, blocks, text, cut)
    windows, place, names = _broadcast(blocks[0]), docs.columns.index(text), docs.columns
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            report, texts = _report(batch.column(place), lambda w: known.hits(w), cut)
            columns = [texts if cut and i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *report], names=[*names, *(n for n, _ in REPORT)])
    return map_arrow(docs, run, schema)


def _report(column: pa.Array, hits, cut: bool) -> tuple[list[pa.Array], pa.Array]:
    n_words, n_hit, n_items, digests, changed = [], [], [], [], {}
    for lo, hi, w in words_of(column, ALNUM, LOWER):
        ranges, found = hits(w)
        n_words += w.counts.tolist()
        if not ranges:
            n_hit += [0] * (hi - lo)
            n_items += [0] * (hi - lo)
            digests += [_digest(set())] * (hi - lo)
            continue
        cover = _covered(len(w), ranges)
        sums = np.concatenate(([0], np.cumsum(cover)))
        n_hit += (sums[w.first[1:]] - sums[w.first[:-1]]).tolist()
        items: dict[int, set] = {}
        for t, x in found:
            items.setdefault(t, set()).add(x)
        n_items += [len(items.get(i, ())) for i in range(hi - lo)]
        digests += [_digest(items.get(i, set())) for i in range(hi - lo)]
        if cut:
            for i in items:
                a, b = int(w.first[i]), int(w.first[i + 1])
                changed[lo + i] = cut_words(column[lo + i].as_py(), w.starts[a:b] - w.offsets[i], cover[a:b])
    report = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()),
              pa.array([h > 0 for h in n_hit], pa.bool_())]
    if not changed:
        return report, column
    return report, pa.array([changed.get(i, x) for i, x in enumerate(column.to_pylist())], pa.string())


def cut_words(text: str, starts: np.ndarray, gone: np.ndarray) -> str:
    """The text without the marked words and what stands between each of them and the next word."""
    raw = text.encode()
    ends = np.append(starts[1:], len(raw))
    keep = [raw[: int(starts[0])]]
    keep += [raw[int(s) : int(e)] for s, e, g in zip(starts, ends, gone, strict=True) if not g]
    return b"".join(keep).decode()


def _scan_blocks(docs: DataFrame, blocks: list, text: str, cut: bool) -> DataFrame:
    """One scan per block; hits of a document are merged by a row id fixed in a stored copy of the documents."""
    rid = free_name(docs.columns, "row_id")
    kept = store(docs.withColumn(rid, F.monotonically_increasing_id()), "documents")
    hits = None
    for block in blocks:
        known = _broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for lo, _, w in words_of(batch.column(1), ALNUM, LOWER):
                    ranges, found = known.value.hits(w)
                    spans: dict[int, list] = {}
                    for a, b in ranges:
                        t = int(w.text[a])
                        spans.setdefault(t, []).append({"at": int(a - w.first[t]), "size": b - a})
                    names: dict[int, set] = {}
                    for t, x in found:
                        names.setdefault(t, set()).add(x)
                    if spans:
                        yield pa.RecordBatch.from_pydict(
                            {"rid": [int(ids[lo + t]) for t in spans], "spans": list(spans.values()), "items": [sorted(names[t]) for t in spans]},
                            schema=pa.schema([("rid", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))), ("items", pa.list_(pa.string()))]))
        found = map_arrow(kept.select(F.col(quoted(rid)), F.col(quoted(text))), find, "rid long, spans array<struct<at:long,size:long>>, items array<string>")
        part = store(found, "hits")
        known.destroy()
        hits = part if hits is None else hits.unionAll(part)
    spans_name, items_name = free_name(docs.columns, "hit_spans"), free_name(docs.columns, "hit_items")
    merged = hits.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias(spans_name),
                                     F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_name)).withColumnRenamed("rid", rid)
    joined = kept.join(merged, rid, "left").select(*[quoted(c) for c in docs.columns], quoted(spans_name), quoted(items_name))
    place, names = docs.columns.index(text), docs.columns
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            done = [0]

            def hits(w: Words, done=done) -> tuple[list, list]:
                ranges, found = [], []
                for t in range(len(w.counts)):
                    row = done[0] + t
                    ranges += [(int(w.first[t]) + x["at"], int(w.first[t]) + x["at"] + x["size"]) for x in spans[row] or ()]
                    found += [(t, x) for x in items[row] or ()]
                done[0] += len(w.counts)
                return ranges, found
            report, texts = _report(batch.column(place), hits, cut)
            columns = [texts if cut and i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *report], names=[*names, *(n for n, _ in REPORT)])
    return map_arrow(joined, run, schema)
