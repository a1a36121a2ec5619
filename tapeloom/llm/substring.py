"""Substring dedup: seeds are winnowed anchors, extended both ways inside the documents that share them.

Words are runs of bytes other than space and 9-13. A window is ``length`` consecutive words of one document; a word goes
if it is covered by a window whose word sequence also starts anywhere else. Such windows, run together, are the
maximal repeats over the length threshold.

Method, with no pairs made:
1. Anchors. Every window picks the k-gram with the lowest hash among its own (the last of equal ones), so equal windows
   pick the same k-gram at the same place, and any repeat of the threshold length has a common anchor. The
   windows that pick one occurrence of an anchor are consecutive and span a *block* of words around it.
2. Seeds. Occurrences of anchors that occur once are dropped (counts with map-side combine, then a semi join that AQE
   splits when hot).
3. Extension. An occurrence extends to its whole block, and over neighbouring blocks as runs, if an equal one exists. Where blocks of an anchor differ, they
   are extended word by word: one occurrence of each block gives the hashes of its windows, weighted by how often the
   block occurs, and windows of single blocks that are counted twice or more are repeats.
4. The word ranges of a document meet its text again (compressed, by row id) and are cut out.
A key's rows never meet in one task except as counts; what is gathered per document is bounded by the document.

Windows are compared by two independent 64-bit hashes over word hashes (blocks: block and anchor hash). The odds of one
wrong removal among n windows are about n**2 / 2**129, apart from equal hashes of different words (n_words**2 / 2**65).

Defined cases: null text has no words and stays null; empty texts and texts under ``length`` words are kept whole;
repeated rows are copies of each other (all lose their repeated windows); an empty table gives no rows; further columns
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.packed import as_text, pack, unpack
from tapeloom.llm.tables import free_name, map_arrow, quoted, release, store
from tapeloom.llm.wordhash import GRAM_BASE, NOT_SPACE, SECOND_BASE, U, Words, grams, inverse, mix, powers, sliding_min, words_of

LENGTH, GRAM = 35, 8
CHAIN = 3  # one anchor in so many begins a run of blocks
PLACE_BITS = 30  # a text has fewer words than this many bits count
_MASK = U((1 << PLACE_BITS) - 1)
ANCHOR_SCHEMA = "anchor long, block long, rid long, start int, n int"


def anchors(w: Words, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor hash, block hash) of every block of the words."""
    empty = np.zeros(0, np.int64)
    if len(w) < length:
        return empty, empty, empty, empty
    seeds = mix(grams(w.hash, gram))
    places = np.arange(len(seeds), dtype=U)
    best = sliding_min((seeds & ~_MASK) | (_MASK - places), length - gram + 1)
    chosen = (_MASK - (best & _MASK)).astype(np.int64)
    begin = np.flatnonzero(np.arange(len(chosen)) + length <= w.stop[: len(chosen)])
    if not len(begin):
        return empty, empty, empty, empty
    picked = chosen[begin]
    cut = np.flatnonzero((picked[1:] != picked[:-1]) | (begin[1:] != begin[:-1] + 1)) + 1
    lo, hi = begin[np.concatenate(([0], cut))], begin[np.concatenate((cut - 1, [len(begin) - 1]))]
    n = len(w) + 1
    prefix = np.zeros(n, U)
    np.cumsum(mix(w.hash ^ SECOND_BASE) * powers(SECOND_BASE, n - 1), dtype=U, out=prefix[1:])
    block = mix((prefix[hi + length] - prefix[lo]) * powers(inverse(SECOND_BASE), n)[lo] + (hi - lo).astype(U))
    return lo, hi, seeds[chosen[lo]].view(np.int64), block.view(np.int64)


def window_keys(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``length`` words."""
    return (mix(grams(w.hash, length, GRAM_BASE)).view(np.int64), mix(grams(mix(w.hash ^ SECOND_BASE), length, SECOND_BASE)).view(np.int64))


def repeats(packed: DataFrame, text: str, rid: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, spans): for each document with repeats, its repeated windows as runs [first window, number of windows]."""
    source = packed.select(F.col(quoted(rid)).alias("rid"), F.col(quoted(text)).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, w in words_of(as_text(unpack(batch.column(1))), NOT_SPACE):
                first, last, anchor, block = anchors(w, length, gram)
                if len(first):
                    of = w.text[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(block), pa.array(ids[lo + of]), pa.array((first - w.first[of]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                        names=["anchor", "block", "rid", "start", "n"])
    seeds = store(source.mapInArrow(find, ANCHOR_SCHEMA), "anchors")
    # counted sides are written first: a join whose sides are both plain shuffles is one that AQE can split at a hot key
    again = store(seeds.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors-again")
    shared = store(seeds.join(again, "anchor", "left_semi"), "shared-anchors")
    release(seeds)
    blocks = store(shared.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.min(F.struct("rid", "start", "n")).alias("at")), "blocks")
    differ = store(blocks.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "anchors-that-differ")
    whole = _whole_blocks(shared, blocks)
    edges = blocks.join(differ, "anchor", "left_semi").select("at.*", "c")
    asked = edges.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "c")).alias("asked"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [i for i, x in enumerate(lists) if x]
            if not rows:
                continue
            texts = as_text(unpack(batch.column(1).take(pa.array(rows))))
            for lo, hi, w in words_of(texts, NOT_SPACE):
                one, two = window_keys(w, length)
                rid_out, place, at, weight = [], [], [], []
                for i in range(lo, hi):
                    base = int(w.first[i - lo])
                    for x in lists[rows[i]]:
                        span = np.arange(x["start"], x["start"] + x["n"])
                        place.append(span)
                        at.append(span + base)
                        rid_out.append(np.full(len(span), ids[rows[i]], np.int64))
                        weight.append(np.full(len(span), min(x["c"], 2), np.int32))
                if at:
                    where = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[where]), pa.array(two[where]), pa.array(np.concatenate(rid_out)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(weight))],
                        names=["one", "two", "rid", "start", "c"])
    windows = source.join(asked, "rid", "left").select("rid", "text", "asked").mapInArrow(extend, "one long, two long, rid long, start int, c int")
    windows = store(windows, "edge-windows")
    twice = store(windows.groupBy("one", "two").agg(F.sum("c").alias("s")).where("s > 1").select("one", "two"), "windows-again")
    single = windows.where("c = 1").join(twice, ["one", "two"], "left_semi").select("rid", "start", F.lit(1).alias("n"))
    return whole.unionAll(single).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _whole_blocks(shared: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rid, start, n): the occurrences of blocks that occur more than once, neighbours taken together where possible.

    Consecutive shared blocks of a document are chained to runs that begin where the content says so (anchors divisible
    by ``CHAIN``), so a passage of many documents has equal runs in all of them. A run that occurs again needs one row, not one per
    block; the blocks of other runs are looked up one by one.
    """
    listed = shared.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "n", "anchor", "block"))).alias("at"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            flat = lists.flatten()
            start, n, anchor, block = (flat.field(i).to_numpy() for i in range(4))
            sizes = np.diff(lists.offsets.to_numpy())
            new = np.zeros(len(start), bool)
            new[np.cumsum(sizes) - sizes] = True
            new[1:] |= (start[:-1] + n[:-1] != start[1:]) | (anchor[1:] % CHAIN == 0)
            first = np.flatnonzero(new)
            rid = np.repeat(batch.column(0).to_numpy(), sizes)
            place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
            both = mix(block.view(U) * powers(GRAM_BASE, int(place.max()) + 1)[place] + anchor.view(U))
            one, two = np.add.reduceat(both, first), np.add.reduceat(mix(both ^ SECOND_BASE), first)
            offsets = pa.array(np.append(first, len(start)).astype(np.int32))
            parts = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(anchor), pa.array(block), pa.array(start), pa.array(n)], names=["anchor", "block", "start", "n"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64)), pa.array(rid[first]), pa.array(start[first]), pa.array(np.add.reduceat(n, first).astype(np.int32)), parts],
                names=["one", "two", "rid", "start", "n", "parts"])
    runs = store(listed.mapInArrow(chain, "one long, two long, rid long, start int, n int, parts array<struct<anchor: long, block: long, start: int, n: int>>"), "runs")
    again = store(runs.groupBy("one", "two").agg(F.count("*").alias("c")).where("c > 1").select("one", "two"), "runs-again")
    chained = runs.drop("parts").join(again, ["one", "two"], "left_semi").select("rid", "start", "n")
    single = runs.join(again, ["one", "two"], "left_anti").select("rid", F.inline("parts"))
    twice = blocks.where("c > 1").select("anchor", "block")
    return chained.unionAll(single.join(twice, ["anchor", "block"], "left_semi").select("rid", "start", "n"))


def gone_words(n_words: int, spans: list | None, length: int) -> np.ndarray:
    """True for each word that a repeated window covers."""
    step = np.zeros(n_words + 1, np.int32)
    for x in spans or ():
        step[x["start"]] += 1
        step[x["start"] + x["n"] + length - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def _with_spans(docs: DataFrame, text: str, length: int, gram: int) -> tuple[DataFrame, int]:
    """The packed documents with their spans in the last column; the place of the text."""
    packed, rid = pack(docs, text, "documents")
    name = free_name(packed.columns, "spans")
    spans = repeats(packed, text, rid, length, gram).select(F.col("rid").alias(rid), F.col("spans").alias(name))
    return packed.join(spans, rid, "left").select(*[quoted(c) for c in docs.columns], name), docs.columns.index(text)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), kept words joined by one space."""
    joined, _ = _with_spans(docs.select(F.col(quoted(doc_id)), F.col(quoted(text))), text, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for raw, spans in zip(unpack(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (raw or b"").split()
                n.append(len(words))
                if spans:
                    gone = gone_words(len(words), spans, length)
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=[doc_id, "n_words", "n_removed", "kept_sha256"])
    return map_arrow(joined, run, T.StructType([docs.schema[doc_id], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; what stands between a removed word and the next goes too."""
    names, schema = docs.columns, docs.schema
    joined, place = _with_spans(docs, text, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, spans in zip(unpack(batch.column(place)), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_SPACE)
                    ends = np.append(w.starts[1:], len(raw))
                    gone = gone_words(len(w), spans, length)
                    raw = raw[: int(w.starts[0])] + b"".join(raw[int(s) : int(e)] for s, e in zip(w.starts[~gone], ends[~gone], strict=True))
                texts.append(None if raw is None else raw.decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(names))], names=names)
    return map_arrow(joined, run, schema)
