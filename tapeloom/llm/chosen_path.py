"""N-gram Jaccard self-join of texts by chosen paths: near-duplicate classes and link counts.

A text's set holds its shingles of ``shingle`` words (words: bytes other than space and 9-13; a shorter text with words is
one shingle). Two texts are linked when their sets have a Jaccard similarity of ``threshold`` or more.

Method:
1. Equal sets are collapsed to one representative with a copy count, so exact copies are never paired.
2. Each run starts from all sets and splits them on a sampled shared token (the minimum of a seeded hash over the set:
   two sets share it with a chance equal to their similarity). Buckets above ``bucket`` sets are split again on the next
   token of the path, up to ``depth`` times. Runs repeat until a pair at the threshold has met with ``recall``.
3. Buckets are brute-forced on the sampled tokens (agreement well below the threshold, so that the chance to lose a pair is
   under 1e-6): they give candidate edges, a spanning forest of each bucket. A bucket still too large at full depth
   joins as a star, which only makes candidates coarser.
4. Connected candidates are compared exactly, in blocks of at most ``block`` sets by ``block`` sets: each set is shipped to
   the blocks of its own component only, similarities come from one incidence matrix per block, and a block
   returns per set its number of links and the least set it is connected to. No pair is written as a row.
5. Components of the true links are the classes.

``n_links`` counts documents (copies included), ``n_text_links`` sets. Sizes of all steps follow the candidates; a class of n
different texts costs n**2 / 2 comparisons in blocks, as its exact link counts need, but n * (n / block) rows. All joins are
sort-merge joins: both sides grow with the documents, and what a broadcast of them would hold on the driver grows too.

Recall: a pair at the threshold is missed by a chance under 1 - ``recall`` if its path is split at every level, far less
otherwise, and not at all if it is connected over others. Hashes have 64 bits (sets: 128).

Defined cases: null, empty and white-space texts have no set: class of their own, no links; repeated rows are copies;
an empty table gives no rows; a null doc_id takes part and counts last when the least id names a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.components import components
from tapeloom.llm.packed import as_text, pack, unpack
from tapeloom.llm.tables import growing, map_arrow, quoted, store
from tapeloom.llm.wordhash import NOT_SPACE, U, Words, grams, mix, words_of

SHINGLE, THRESHOLD, RECALL, DEPTH, BUCKET, BLOCK = 5, 0.8, 0.99999, 3, 64, 256
SLACK = 0.3  # agreement of sampled tokens may fall this far below the threshold: over five standard deviations of 51


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    """Runs until a pair at the threshold has stayed together on a path of ``depth`` tokens at least once."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def seeds(n: int) -> np.ndarray:
    """Odd multipliers of the sampling hashes."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(w: Words, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    whole = mix(grams(w.hash, shingle))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        else:
            out.append(mix(grams(w.hash[a:b], b - a)) if b > a else np.zeros(0, U))
    return out


def sample(tokens: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each multiplier the token with the least product; long sets in slices."""
    mixed = tokens ^ (tokens >> U(32))
    best = np.full(len(multipliers), np.iinfo(U).max, U)
    for lo in range(0, len(mixed), 4096):
        np.minimum(best, (multipliers[:, None] * mixed[None, lo : lo + 4096]).min(axis=1), out=best)
    return best.view(np.int64)


def _sets(packed: DataFrame, text: str, rid: str, shingle: int, tokens: int) -> DataFrame:
    """(rid, k1, k2, sampled): hash of the set in two halves and its sampled tokens; null keys where there is no set."""
    multipliers = seeds(tokens)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, picked = [], [], []
            for _, _, w in words_of(as_text(unpack(batch.column(1))), NOT_SPACE):
                for s in shingle_sets(w, shingle):
                    if len(s):
                        k1.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                        k2.append(int((np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)).view(np.int64)))
                        picked.append(sample(s, multipliers))
                    else:
                        k1.append(None)
                        k2.append(None)
                        picked.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(picked, pa.list_(pa.int64()))], names=["rid", "k1", "k2", "sampled"])
    return packed.select(F.col(quoted(rid)).alias("rid"), F.col(quoted(text)).alias("text")).mapInArrow(scan, "rid long, k1 long, k2 long, sampled array<long>")


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut at the end of a key's rows, of input that is sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy()
        new = np.flatnonzero(column[1:] != column[:-1]) + 1
        cut = int(new[-1]) if len(new) else 0
        if held and (cut or column[0] != held[-1].column(key)[-1].as_py()):
            if column[0] != held[-1].column(key)[-1].as_py():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the least node of its component."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(reach, label[None, :], len(linked)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _bucket_edges(leaves: DataFrame, least_agreement: float) -> DataFrame:
    """(a, b): a spanning forest of the sets in a bucket whose sampled tokens agree often enough."""
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 0):
            path, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            picked = lists.flatten().to_numpy().reshape(len(rid), -1)
            bounds = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
            a_out, b_out = [], []
            twos = np.flatnonzero(np.diff(bounds) == 2)
            if len(twos):
                i = bounds[twos]
                good = (picked[i] == picked[i + 1]).mean(axis=1) >= least_agreement
                a_out.append(rid[i[good]])
                b_out.append(rid[i[good] + 1])
            for g in np.flatnonzero(np.diff(bounds) > 2):
                lo, hi = bounds[g], bounds[g + 1]
                agree = np.zeros((hi - lo, hi - lo), np.int32)
                for column in picked[lo:hi].T:
                    agree += column[:, None] == column[None, :]
                label = forest(agree >= least_agreement * picked.shape[1])
                moved = np.flatnonzero(label != np.arange(hi - lo))
                a_out.append(rid[lo + moved])
                b_out.append(rid[lo + label[moved]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
    return leaves.repartition("path").sortWithinPartitions("path").select("path", "rid", "sampled").mapInArrow(pair, "a long, b long")


def candidate_edges(sets: DataFrame, threshold: float, depth: int, recall: float, bucket: int) -> DataFrame:
    """Candidate edges over all runs and levels; ``sets`` has rid and sampled."""
    runs = runs_needed(threshold, depth, recall)
    firsts = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.xxhash64(r, F.get("sampled", r * depth)).alias("path")))
    rows = sets.select("rid", F.explode(firsts).alias("x")).select("rid", "x.run", "x.path")
    edges = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("rid").alias("least")).where("n > 1")
        known = store(rows.join(growing(sizes), "path"), f"paths-{level}")
        small = known.where(F.col("n") <= bucket).join(growing(sets), "rid").select("path", "rid", "sampled")
        found = _bucket_edges(small, threshold - SLACK)
        large = known.where(F.col("n") > bucket)
        if level == depth:
            found = found.unionAll(large.where("rid <> least").select(F.col("rid").alias("a"), F.col("least").alias("b")))
        else:
            rows = large.join(growing(sets), "rid").select("rid", "run", F.xxhash64("path", F.get("sampled", F.col("run") * depth + level)).alias("path"))
        edges = found if edges is None else edges.unionAll(found)
    return edges


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Members (rid, label, copies) with the blocks their component is compared in: (job, side, rid, copies).

    A component of more than ``block`` sets is dealt into parts by hash; every pair of parts is a job. Side 0 is the first
    part, side 1 the second, side 2 a part compared with itself.
    """
    sizes = members.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = members.join(growing(sizes), "label").withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return other.select(
        F.xxhash64("label", F.least("part", "other"), F.greatest("part", "other")).alias("job"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"), "rid", "copies")


def overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, from slices of the incidence matrix over tokens of two sets or more."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    group = np.cumsum(new) - 1
    shared = np.bincount(group) > 1
    keep = shared[group]
    owner, group = owner[keep], (np.cumsum(shared) - 1)[group[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    n = int(shared.sum())
    for lo in range(0, n, columns):
        a, b = np.searchsorted(group, [lo, lo + columns])
        part = np.zeros((len(sets), min(columns, n - lo)), np.float32)
        part[owner[a:b], group[a:b] - lo] = 1
        out += part @ part.T
    return out


def _compare(packed: DataFrame, text: str, rid: str, jobs: DataFrame, members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(rid, least, texts, docs): per set and job its links and the least set it is connected to."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for _, _, w in words_of(as_text(unpack(batch.column(1))), NOT_SPACE) for s in shingle_sets(w, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["rid", "tokens"])
    texts = packed.select(F.col(quoted(rid)).alias("rid"), F.col(quoted(text)).alias("text")).join(growing(members.select("rid")), "rid", "left_semi")
    sets = store(texts.select("rid", "text").mapInArrow(tokens, "rid long, tokens binary"), "candidate-sets")

    share = Fraction(threshold).limit_denominator(10_000)  # compared in whole numbers

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 0):
            job, side, ids, copies = (batch.column(i).to_numpy() for i in range(4))
            raw = [np.frombuffer(x.as_buffer(), U) for x in batch.column(4)]
            sizes = np.array([len(x) for x in raw], np.float64)
            bounds = np.concatenate(([0], np.flatnonzero(job[1:] != job[:-1]) + 1, [len(job)]))
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                common = overlaps(raw[lo:hi]).astype(np.float64)
                union = sizes[lo:hi, None] + sizes[None, lo:hi] - common
                linked = common * share.denominator >= share.numerator * union
                s = side[lo:hi]
                linked &= (s[:, None] != s[None, :]) | (s[:, None] == 2)
                np.fill_diagonal(linked, False)
                some = np.flatnonzero(linked.any(axis=1))
                label = forest(linked)
                for place, values in enumerate((ids[lo + some], ids[lo + label[some]], linked[some].sum(axis=1), linked[some] @ copies[lo:hi])):
                    out[place].append(values.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rid", "least", "texts", "docs"])
    dealt = jobs.join(growing(sets), "rid").repartition("job").sortWithinPartitions("job").select("job", "side", "rid", "copies", "tokens")
    return dealt.mapInArrow(compare, "rid long, least long, texts long, docs long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
            recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame, str]:
    """(verdict, packed, row id): ``verdict`` has rid, class_rid (least row id of the class), class_id, n_copies, n_text_links, n_links.

    ``packed`` is the stored copy of ``docs`` whose row ids the verdict uses.
    """
    packed, rid = pack(docs, text, "documents")
    found = store(_sets(packed, text, rid, shingle, runs_needed(threshold, depth, recall) * depth), "sets")
    have = found.where("k1 IS NOT NULL")
    reps = store(have.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "representatives")
    distinct = have.join(growing(reps.select(F.col("rep").alias("rid"))), "rid", "left_semi").select("rid", "sampled")
    near = components(candidate_edges(distinct, threshold, depth, recall, bucket), "a", "b")
    members = store(near.select(F.col("id").alias("rid"), "label").join(growing(reps.select(F.col("rep").alias("rid"), "copies")), "rid"), "candidates")
    checked = store(_compare(packed, text, rid, _blocks(members, block), members, shingle, threshold), "links")
    links = checked.groupBy(F.col("rid").alias("rep")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    true = components(checked.where("rid <> least"), "rid", "least").select(F.col("id").alias("rep"), "label")
    per_set = reps.join(growing(links), "rep", "left").join(growing(true), "rep", "left").select(
        "k1", "k2", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("label", "rep").alias("label"))
    keys = packed.select(F.col(quoted(rid)).alias("rid"), F.col(quoted(doc_id)).alias("id"))
    joined = found.select("rid", "k1", "k2").join(growing(per_set), ["k1", "k2"], "left").select(
        "rid", F.coalesce("label", "rid").alias("class_rid"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    joined = store(joined.join(growing(keys), "rid"), "classes")
    named = joined.groupBy("class_rid").agg(F.min("id").alias("class_id"))
    return joined.join(growing(named), "class_rid"), packed, rid


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies), one row per document; class_id is the least doc_id of the class."""
    verdict, _, _ = classes(docs.select(F.col(quoted(doc_id)), F.col(quoted(text))), doc_id, text, **how)
    return verdict.select(F.col("id").alias(doc_id), "class_id", "n_links", "n_text_links", "n_copies")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id (of equal ids, the first row)."""
    verdict, packed, rid = classes(docs, doc_id, text, **how)
    best = verdict.groupBy("class_rid").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))).alias("best")).select(F.col("best.rid").alias(rid))
    kept = packed.join(growing(best), rid, "left_semi").select(*[quoted(c) for c in docs.columns])
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array([None if x is None else x.decode() for x in unpack(batch.column(place))], pa.string())
            yield pa.RecordBatch.from_arrays([plain if i == place else batch.column(i) for i in range(len(names))], names=names)
    return map_arrow(kept, run, T.StructType(docs.schema.fields))
