"""Snapshots cut out of an ordered feed: a new one starts when a code or rank repeats inside the current one.

The rule is sequential, but a run is described by its start alone once each row knows where its code or rank last occurred: a row opens
a snapshot when that place is not before the current start. What a stretch of rows does to an incoming start is therefore a
step function, and step functions compose. Chunks of bounded size each make theirs, and one call of Python composes those of a block of
chunks; a tree of fan-in ``FAN`` composes the blocks upwards and hands the starts down again, so that one scope spreads over all tasks;
then every chunk labels its rows along pointers to the next break. Chunk work is numpy over whole arrays (pointer doubling), without a
loop over rows.

A step function has one step per place before the stretch that can cause a break, up to the first repeat inside the
stretch: never more than one snapshot has rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import scratch_path

# the small helpers below travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NONE = -(2**62)  # no start yet, no earlier place
FAN_BITS = 5
FAN = 1 << FAN_BITS


class Steps(NamedTuple):
    """A start at or below ``limits[i]`` (and above the one before) leaves as ``ends[i]``; above all limits it passes through."""
    first: int  # position of the first row
    fresh: int  # the start handed on if none comes in
    limits: np.ndarray
    ends: np.ndarray

    def apply(self, starts: np.ndarray) -> np.ndarray:
        if not len(self.limits):
            return np.where(starts == NONE, self.fresh, starts)
        at = np.searchsorted(self.limits, starts, side="left")
        out = np.where(at < len(self.limits), self.ends[np.minimum(at, len(self.limits) - 1)], starts)
        return np.where(starts == NONE, self.fresh, out)


def tidy(first: int, fresh: int, limits: np.ndarray, ends: np.ndarray) -> Steps:
    """Steps that no start before ``first`` can reach are dropped, equal neighbours are one step."""
    beyond = int(np.searchsorted(limits, first - 1, side="left"))
    limits, ends = limits[: beyond + 1].copy(), ends[: beyond + 1]
    if len(limits):
        limits[-1] = min(limits[-1], first - 1)
    last = np.append(ends[1:] != ends[:-1], True)[: len(ends)]
    return Steps(first, fresh, limits[last], ends[last])


def compose(before: Steps, after: Steps) -> Steps:
    """The step function of two neighbouring stretches; associative."""
    top = before.limits[-1] if len(before.limits) else NONE
    more = after.limits > top
    fresh = int(after.apply(np.array([before.fresh]))[0])
    return tidy(before.first, fresh, np.concatenate([before.limits, after.limits[more]]), np.concatenate([after.apply(before.ends), after.ends[more]]))


def previous(positions: np.ndarray, values: pd.Series, earlier: pd.Series) -> np.ndarray:
    """Position of the last earlier row with the same value; ``earlier`` has those before the chunk, by value."""
    code, known = pd.factorize(values)
    order = np.argsort(code, kind="stable")
    again = np.append(False, code[order][1:] == code[order][:-1])
    out = np.full(len(positions), NONE)
    out[order[again]] = positions[order[np.flatnonzero(again) - 1]]
    firsts = order[~again]
    if len(earlier):
        out[firsts] = earlier.reindex(known[code[firsts]]).fillna(NONE).to_numpy("int64")
    return out


def next_breaks(positions: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """For a snapshot that starts at each row, the index of the row that ends it; n if none does, and n itself."""
    n = len(positions)
    out = np.full(n + 1, n)
    inside = np.flatnonzero(prev >= positions[0])
    np.minimum.at(out, np.searchsorted(positions, prev[inside]), inside)
    out[:n] = np.minimum.accumulate(out[:n][::-1])[::-1]
    return out


def chunk_steps(positions: np.ndarray, prev: np.ndarray) -> Steps:
    n = len(positions)
    ends = next_breaks(positions, prev)[:n]
    jump = np.where(ends < n, ends, np.arange(n))
    for _ in range(n.bit_length()):
        jump = jump[jump]
    final = positions[jump]
    highest = np.maximum.accumulate(prev)
    rises = np.flatnonzero(np.append(True, highest[1:] > highest[:-1]) & (prev > NONE))
    return tidy(int(positions[0]), int(final[0]), prev[rises], final[rises])


def chunk_labels(positions: np.ndarray, prev: np.ndarray, start: int) -> np.ndarray:
    """Start of the snapshot of each row, ``start`` being the one that comes in."""
    n = len(positions)
    opens = 0 if start == NONE else int(np.searchsorted(np.maximum.accumulate(prev), start, side="left"))
    mark, step = np.zeros(n + 1, bool), next_breaks(positions, prev)
    mark[opens] = True
    for _ in range(n.bit_length()):
        mark[step[mark]] = True
        step = step[step]
    last = np.maximum.accumulate(np.where(mark[:n], np.arange(n), -1))
    return np.where(last < 0, start, positions[last])


def chunks_of(positions: np.ndarray, bits: int) -> list[slice]:
    """The chunks of a block's rows."""
    cuts = np.flatnonzero(np.diff(positions >> bits)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(positions)], strict=True)]


def segment_snapshots(
    feed: DataFrame, scope: Sequence[str], order: str, code: str, rank: str, *, chunk_rows: int = 8192, block_rows: int = 8192,
    segment: str = "segment_start",
) -> DataFrame:
    """``feed`` with the ``order`` at which the snapshot of each row starts.

    ``order`` is a whole-number position, unique inside a scope; ``chunk_rows`` and ``block_rows`` are powers of two. Missing
    codes and ranks count as one value; scopes may be null. A call of Python takes a block of chunks, so that small chunks do not cost
    a call each. What the blocks found, the levels of the tree and the labels are written below the checkpoint folder, about 40
    bytes a row, so that no use of the result computes them again.
    """
    if any(n < 1 or n & (n - 1) for n in (chunk_rows, block_rows)):
        raise ValueError("chunk_rows and block_rows must be powers of two")
    scope = list(scope)
    chunk_bits = chunk_rows.bit_length() - 1
    block_bits = max(chunk_bits, block_rows.bit_length() - 1)

    def written(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(feed.sparkSession, name)
        frame.write.parquet(path)
        return feed.sparkSession.read.schema(frame.schema).parquet(path)
    position = F.col(order).cast("bigint")
    rows = feed.select(
        *scope, F.shiftright(position, block_bits).alias("_node"), position.alias("_o"),
        F.coalesce(F.col(code).cast("string"), F.lit("\0")).alias("_code"), F.coalesce(F.col(rank).cast("string"), F.lit("\0")).alias("_rank"))
    marks = F.explode(F.array(
        F.struct(F.lit("c").alias("kind"), F.col("_code").alias("value")), F.struct(F.lit("r").alias("kind"), F.col("_rank").alias("value"))))
    last = rows.select(*scope, "_node", "_o", marks.alias("_m")).groupBy(
        *scope, "_node", F.col("_m.kind").alias("kind"), F.col("_m.value").alias("value")).agg(F.max("_o").alias("_last"))
    over = Window.partitionBy(*scope, "kind", "value").orderBy("_node")
    earlier = last.select(*scope, "_node", "kind", "value", F.lag("_last").over(over).alias("_prev")).where("_prev IS NOT NULL")

    fields = [feed.schema[c] for c in scope]
    longs = T.ArrayType(T.LongType())
    node_fields = [*fields, T.StructField("_node", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_fresh", T.LongType()),
                   T.StructField("_limits", longs), T.StructField("_ends", longs)]

    def row_of(key: tuple, steps: Steps, **more) -> pd.DataFrame:
        values = [*key, steps.first, steps.fresh, steps.limits, steps.ends, *more.values()]
        return pd.DataFrame({n: pd.Series([v], dtype=object if isinstance(v, np.ndarray) else None) for n, v in zip([*(f.name for f in node_fields), *more], values, strict=True)})

    def make_block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_o")
        positions = left["_o"].to_numpy()
        seen = [right[right["kind"] == k].set_index("value")["_prev"] for k in "cr"]
        prev = np.maximum(previous(positions, left["_code"], seen[0]), previous(positions, left["_rank"], seen[1]))
        steps = reduce(compose, [chunk_steps(positions[at], prev[at]) for at in chunks_of(positions, chunk_bits)])
        return row_of(key, steps, _positions=positions, _places=prev)

    made = rows.groupBy(*scope, "_node").cogroup(earlier.groupBy(*scope, "_node")).applyInPandas(
        make_block, T.StructType([*node_fields, T.StructField("_positions", longs), T.StructField("_places", longs)]))
    blocks = written(made, "segments")
    lowest, highest = blocks.agg(F.min("_node"), F.max("_node")).first()
    span = 0 if lowest is None else highest - lowest
    blocks = blocks.withColumn("_node", F.col("_node") - (lowest or 0))

    def steps_of(pdf: pd.DataFrame) -> list[Steps]:
        return [Steps(*r) for r in pdf.sort_values("_node")[["_first", "_fresh", "_limits", "_ends"]].itertuples(index=False, name=None)]

    def ascend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, *others = steps_of(pdf)
        for other in others:
            first = compose(first, other)
        return row_of(key, first)

    def descend(key: tuple, children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        start, starts = int(parent["_entry"].iloc[0]), []
        for steps in steps_of(children):
            starts.append(start)
            start = int(steps.apply(np.array([start]))[0])
        out = children.sort_values("_node")[[*scope, "_node"]].copy()
        out["_entry"] = np.array(starts, dtype="int64")
        return out

    levels = [blocks.select(*[f.name for f in node_fields])]
    while span > 0:
        level = levels[-1].groupBy(*scope, F.shiftright("_node", FAN_BITS).alias("_node")).applyInPandas(ascend, T.StructType(node_fields))
        levels.append(written(level, "segment-level"))
        span >>= FAN_BITS
    entry_schema = T.StructType([*fields, T.StructField("_node", T.LongType()), T.StructField("_entry", T.LongType())])
    entries = levels[-1].select(*scope, "_node", F.lit(NONE).alias("_entry"))
    for level in reversed(levels[:-1]):
        up = level.groupBy(*scope, F.shiftright("_node", FAN_BITS).alias("_up"))
        entries = up.cogroup(entries.withColumnRenamed("_node", "_up").groupBy(*scope, "_up")).applyInPandas(descend, entry_schema)

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """Null-safe join; the right names are renamed, as one block makes ``entries`` a selection of ``blocks`` itself."""
        renamed = right.withColumnsRenamed({n: f"_same_{n}" for n in names})
        return left.join(renamed, [F.col(n).eqNullSafe(F.col(f"_same_{n}")) for n in names]).drop(*[f"_same_{n}" for n in names])
    met = same(blocks, entries, [*scope, "_node"]).select(*scope, "_positions", "_places", "_entry")
    label_schema = T.StructType([*fields, T.StructField("_o", T.LongType()), T.StructField(segment, T.LongType())])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record in pdf.itertuples(index=False, name=None):
                *where, positions, prev, entry = record
                out = {n: pd.Series([v] * len(positions), dtype=pdf[n].dtype) for n, v in zip(scope, where, strict=True)}
                found, start = [], int(entry)
                for at in chunks_of(positions, chunk_bits):
                    found.append(chunk_labels(positions[at], prev[at], start))
                    start = int(found[-1][-1])
                yield pd.DataFrame({**out, "_o": positions, segment: np.concatenate(found)})

    labels = written(met.mapInPandas(label, label_schema), "segment-labels").withColumnRenamed("_o", order)
    return same(feed, labels, [*scope, order]).select(*[feed[c] for c in feed.columns], segment)
