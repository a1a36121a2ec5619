"""Alias dedup, compatible merge, and snapshot selection.

All of these keep "first row wins" semantics through an explicit order column. Groups are
reduced by partial aggregation wherever the rule allows it; what is truly sequential is
streamed in order with constant state, and only for the few keys that need it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import types as tt
from tapeloom.operators.ranking import latest_per_key
from tapeloom.operators.segments import segment_snapshots  # noqa: F401 - part of this module's functions

# the small helpers below travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------- code aliases


def map_alias(df: DataFrame, aliases: DataFrame, code: str = "ts_code") -> DataFrame:
    """Replace retired codes; ``aliases`` has (old_code, new_code) and unknown codes pass."""
    side = aliases.select(F.col("old_code").alias(code), F.col("new_code").alias("_new"))
    joined = df.join(side, code, "left")
    renamed = F.col("_new").isNotNull() & (F.col("_new") != F.col(code))
    return (
        joined.withColumn("is_alias", renamed)
        .withColumn("source_code", F.col(code))
        .withColumn(code, F.coalesce("_new", code)).drop("_new")
    )


def dedup_alias(
    mapped: DataFrame, keys: Sequence[str], order: str, *, alias_flag: str = "is_alias"
) -> DataFrame:
    """One row per key: the current code beats an aliased one, then source order."""
    return latest_per_key(mapped, keys, [F.col(alias_flag).asc(), F.col(order).asc()])


def alias_conflicts(
    mapped: DataFrame, keys: Sequence[str], matching: Sequence[str], *, order: str | None = None, alias_flag: str = "is_alias"
) -> DataFrame:
    """Keys where two rows of the same kind (both current or both aliased) disagree.

    With ``order``, aliased rows count only before the key's first current row, which replaces them: those behind it (or at
    the same place) are dropped whatever they say. Without it, all rows of a kind are compared. NULL agrees with NULL only.
    """
    fields = [c for c in matching if c not in keys]
    if order is None:
        variants = mapped.select(*keys, alias_flag, *fields).distinct()
    else:
        first = mapped.groupBy(*keys, alias_flag, *fields).agg(F.min(order).alias("_first"))
        current = F.min(F.when(~F.col(alias_flag), F.col("_first"))).over(Window.partitionBy(*keys))
        variants = first.withColumn("_current", current).where(
            ~F.col(alias_flag) | F.col("_current").isNull() | (F.col("_first") < F.col("_current")))
    return variants.groupBy(*keys, alias_flag).agg(F.count("*").alias("variants")).where(F.col("variants") > 1)


def alias_report(mapped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows read, rows left after dedup, rows dropped and codes mapped."""
    per_key = mapped.groupBy(*keys).agg(F.count("*").alias("n"))
    codes = mapped.where("is_alias").agg(F.count_distinct("source_code")).scalar()
    return per_key.agg(
        F.sum("n").alias("rows_read"), F.count("*").alias("rows_kept"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
    ).withColumn("codes_mapped", codes)


# ---------------------------------------------------------------- exact duplicates


def dedup_exact(
    df: DataFrame, keys: Sequence[str], order: str | None = None, *, keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drop rows equal on all columns; also return keys whose rows still conflict. ``keep`` writes the distinct rows once for both."""
    columns = [c for c in df.columns if c != order]
    if order is None:
        unique = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    else:
        unique = df.groupBy(*columns).agg(F.count("*").alias("copies"), F.min(order).alias(order))
    if keep is not None:
        unique = keep(unique, "distinct")
    conflicts = unique.groupBy(*keys).agg(F.count("*").alias("variants")).where(F.col("variants") > 1)
    return unique, conflicts


# ---------------------------------------------------------------- compatible merge


def digits(value: Column) -> Column:
    """Decimal places of the shortest text form, at least one."""
    fraction = F.split_part(value.cast(tt.EXACT).cast("string"), F.lit("."), F.lit(2))
    return F.greatest(F.lit(1), F.length(F.rtrim(fraction, F.lit("0"))))


def _py_digits(value: Decimal) -> int:
    return max(1, -value.normalize().as_tuple().exponent)


def _py_exact(value: object) -> Decimal:
    return value if isinstance(value, Decimal) else Decimal(str(value))


class MergeRules:
    """Which columns may differ and by how much.

    ``free`` columns keep their first value, ``money`` and ``rate`` columns may differ inside
    an absolute and a relative bound and keep the value with more decimals (doubles count by
    their shortest form); every other non-key column must agree. NULL agrees with anything.
    """

    def __init__(self, keys: Sequence[str], order: str, *, free: Sequence[str] = (), money: Sequence[str] = (), rate: Sequence[str] = (), strict: Sequence[str] = ()) -> None:
        self.keys, self.order = list(keys), order
        self.free, self.strict = list(free), list(strict)
        self.bounds = {**{c: tt.MONEY_MERGE_ABS for c in money}, **{c: tt.RATE_MERGE_ABS for c in rate}}

    @property
    def fields(self) -> list[str]:
        return [*self.free, *self.bounds, *self.strict]


def _merge_summary(variants: DataFrame, rules: MergeRules) -> DataFrame:
    """Per key, in one aggregation: how many variants, whether all pairs of them can be merged, and what they merge to.

    If the whole spread of a column is inside the bound of its smallest magnitude, every pair is close and no order of
    merging can fail; the merge then keeps the first value with the most decimals. With exactly two variants the pair rule
    itself is evaluated, so "not compatible" then means a definite conflict.
    """
    def pick(c: str) -> Column:
        rank = F.struct((-digits(F.col(c))).alias("d"), F.col("_first").alias("o")) if c in rules.bounds else F.col("_first")
        return F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)

    aggs = [F.count("*").alias("_n"), F.min("_first").alias("_at")]
    for c in rules.bounds:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.min(F.abs(c)).alias(f"_mag_{c}")]
    for c in rules.strict:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    shape = variants.groupBy(*rules.keys).agg(*aggs, *[pick(c) for c in rules.fields])
    wide = T.DecimalType(38, 14)
    checks = []
    for c, bound in rules.bounds.items():
        lo, hi = F.col(f"_lo_{c}").cast(tt.EXACT), F.col(f"_hi_{c}").cast(tt.EXACT)
        spread = (hi - lo).cast(wide)
        scale = F.when(F.col("_n") == 2, F.greatest(F.abs(lo), F.abs(hi))).otherwise(F.col(f"_mag_{c}").cast(tt.EXACT))
        relative = (scale * F.lit(tt.MERGE_REL).cast("decimal(4,3)")).cast(wide)
        checks.append((F.col("_n") == 1) | lo.isNull() | ((spread <= F.lit(bound).cast("decimal(10,2)")) & (spread <= relative)) | (spread == 0))
    for c in rules.strict:
        checks.append(F.col(f"_lo_{c}").isNull() | (F.col(f"_lo_{c}") == F.col(f"_hi_{c}")))
    ok = reduce(lambda a, b: a & b, checks, F.lit(True))
    status = F.when(F.col("_n") == 1, "kept").when(ok, "merged").when(F.col("_n") == 2, "quarantined").otherwise("fold")
    return shape.select(*rules.keys, "_at", status.alias("status"), *rules.fields)


def merge_compatible(df: DataFrame, rules: MergeRules) -> DataFrame:
    """One row per key, with ``status`` kept / merged / quarantined (measures then NULL).

    The order column of the result is the key's first position in the source.

    Rows of a key are folded in source order: an equal or NULL-subset row is absorbed, close
    values are merged, a real conflict removes the key for good. Exact copies collapse in a
    partial aggregation first. One aggregation over the variants then decides and merges keys whose variants are all
    mutually close and quarantines two-variant conflicts; only keys with three or more partly conflicting
    variants go through the ordered fold.
    """
    df = df.select(*rules.keys, rules.order, *rules.fields)
    variants = df.groupBy(*rules.keys, *rules.fields).agg(F.min(rules.order).alias("_first"))
    summary = _merge_summary(variants, rules)
    kept = [F.when(F.col("status") != "quarantined", F.col(c)).alias(c) for c in rules.fields]
    decided = summary.where("status <> 'fold'").select(*rules.keys, F.col("_at").alias(rules.order), "status", *kept)
    hard = df.join(summary.where("status = 'fold'").select(*rules.keys, "_at"), rules.keys)
    return decided.unionByName(_fold_in_order(hard, rules))


def _fold_in_order(df: DataFrame, rules: MergeRules) -> DataFrame:
    """Ordered fold: rows stream key by key, the state is one row."""
    schema = T.StructType([
        *[df.schema[k] for k in rules.keys], df.schema[rules.order], T.StructField("status", T.StringType()),
        *[T.StructField(c, df.schema[c].dataType) for c in rules.fields],
    ])
    keys, fields, free = rules.keys, rules.fields, set(rules.free)
    bounds = {c: Decimal(b) for c, b in rules.bounds.items()}
    relative = Decimal(tt.MERGE_REL)

    def absorb(state: dict, row: dict) -> dict | None:
        out = dict(state)
        for c in fields:
            a, b = state[c], row[c]
            if b is None or a == b:
                continue
            if a is None:
                out[c] = b
            elif c in bounds:
                x, y = _py_exact(a), _py_exact(b)
                gap = abs(x - y)
                if gap > bounds[c] or gap > max(abs(x), abs(y)) * relative:
                    return None
                if _py_digits(y) > _py_digits(x):
                    out[c] = b
            elif c not in free:
                return None
        return out

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, state, changed = None, None, None, False
        names = [*keys, "_at", *fields]

        def emit() -> list:
            status = "quarantined" if state is None else ("merged" if changed else "kept")
            return [*key, first, status, *[None if state is None else state[c] for c in fields]]

        for pdf in batches:
            done = []
            values = pdf[names].astype(object).where(pdf[names].notna(), None)
            for record in values.itertuples(index=False, name=None):
                k, at, row = record[: len(keys)], record[len(keys)], dict(zip(fields, record[len(keys) + 1:]))
                if k != key:
                    if key is not None:
                        done.append(emit())
                    key, first, state, changed = k, at, row, False
                elif state is not None and row != state:
                    state, changed = absorb(state, row), True
            yield pd.DataFrame(done, columns=[f.name for f in schema])
        if key is not None:
            yield pd.DataFrame([emit()], columns=[f.name for f in schema])

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, rules.order)
    return ordered.mapInPandas(fold, schema)


# ---------------------------------------------------------------- snapshots


def latest_complete_snapshot(feed: DataFrame, scope: Sequence[str], captured: str) -> DataFrame:
    """Rows of the newest capture among the largest captures of each scope."""
    sizes = feed.groupBy(*scope, captured).agg(F.count("*").alias("_size"))
    pick = sizes.groupBy(*scope).agg(F.max(F.struct("_size", captured)).alias("_best"))
    chosen = pick.select(*scope, F.col(f"_best.{captured}").alias(captured))
    return feed.join(chosen, [*scope, captured], "left_semi")


def snapshot_sizes(feed: DataFrame, scope: Sequence[str], captured: str) -> DataFrame:
    """Size of every capture and the largest size in its scope."""
    sizes = feed.groupBy(*scope, captured).agg(F.count("*").alias("size"))
    largest = sizes.groupBy(*scope).agg(F.max("size").alias("complete_size"))
    return sizes.join(largest, list(scope))


def snapshot_duplicates(rows: DataFrame, scope: Sequence[str], code: str, rank: str) -> DataFrame:
    """Codes or ranks that occur twice inside one published snapshot."""
    def repeated(kind: str, column: str) -> DataFrame:
        return (
            rows.groupBy(*scope, column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .select(*scope, F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"), "n")
        )
    return repeated("code", code).unionByName(repeated("rank", rank))


def latest_complete_segment(segments: DataFrame, scope: Sequence[str], captured: str, segment: str = "segment_start") -> DataFrame:
    """Rows of the newest segment among the largest ones; ties go to the earlier segment."""
    sizes = segments.groupBy(*scope, segment).agg(F.count("*").alias("_size"), F.max(captured).alias("_at"))
    pick = sizes.groupBy(*scope).agg(F.max_by(segment, F.struct("_size", "_at", -F.col(segment))).alias(segment))
    return segments.join(pick, [*scope, segment], "left_semi")
