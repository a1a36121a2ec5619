"""Typed projection of a raw feed: output columns plus the first reason a row is unusable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import types as tt
from tapeloom.errors import QualityError
from tapeloom.functions import scalar as sc
from tapeloom.operators import quality as qa

BAD = "_bad"

# Writes rows that are read more than once, under a name (``session.written``).
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Out:
    """One output column, the condition that spoils the row, and its message."""

    name: str
    value: Column
    bad: Column | None = None
    why: str = ""


@dataclass(frozen=True)
class Parsed:
    """An output column whose parser depends on whether the source is text or numeric."""

    name: str
    source: str
    parse: Callable[[Column, bool], Column]
    required: bool

    def resolve(self, schema: T.StructType) -> Out:
        text_source = isinstance(schema[self.source].dataType, T.StringType)
        source = F.col(self.source)
        value = self.parse(source, text_source)
        if self.required:
            return Out(self.name, value, value.isNull(), f"invalid {self.name}")
        return Out(self.name, value, sc.unparsable(source, value, text=text_source), f"invalid {self.name}")


def text(names: str, *, required: bool = False) -> list[Out]:
    return [
        Out(n, sc.clean_text(n), sc.clean_text(n).isNull() if required else None, f"{n} is required")
        for n in names.split()
    ]


def _pairs(names: str, renamed: dict[str, str]) -> list[tuple[str, str]]:
    return [*((n, n) for n in names.split()), *renamed.items()]


def days(names: str, *, required: bool = False) -> list[Parsed]:
    return [Parsed(n, n, lambda c, _: sc.strict_date(c), required) for n in names.split()]


def numbers(dtype: T.DecimalType, names: str = "", *, required: bool = False, **renamed: str) -> list[Parsed]:
    """Decimals; keyword arguments map output name to source name."""
    return [Parsed(o, s, lambda c, t: sc.decimal_value(c, dtype, text=t), required) for o, s in _pairs(names, renamed)]


def floats(names: str) -> list[Out]:
    """Finite doubles, left as they are so repeated reports can be compared exactly."""
    return [
        Out(n, F.col(n).cast("double"), F.isnan(F.col(n).cast("double")) | (F.abs(F.col(n).cast("double")) == float("inf")), f"invalid {n}")
        for n in names.split()
    ]


def scaled(factor: int, names: str = "", *, required: bool = False, dtype: T.DecimalType = tt.QUANTITY, **renamed: str) -> list[Parsed]:
    return [Parsed(o, s, lambda c, t: sc.scaled(c, factor, dtype, text=t), required) for o, s in _pairs(names, renamed)]


def whole(names: str = "", *, required: bool = False, **renamed: str) -> list[Parsed]:
    return [Parsed(o, s, lambda c, t: sc.exact_integer(c, text=t), required) for o, s in _pairs(names, renamed)]


def flags(names: str) -> list[Parsed]:
    return [Parsed(n, n, lambda c, _: sc.flag(c), True) for n in names.split()]


def clocks(names: str) -> list[Parsed]:
    return [Parsed(n, n, lambda c, _: sc.clock(c), False) for n in names.split()]


def choice(name: str, allowed: Sequence[object], *, nullable: bool = False, source: str | None = None, number: bool = False) -> list[Out]:
    """A code from a closed list."""
    src = source or name
    value = sc.exact_integer(src) if number else sc.clean_text(src)
    outside = ~value.isin(*allowed)
    bad = F.coalesce(outside, F.lit(not nullable))
    return [Out(name, value, bad, f"invalid {name}")]


def const(name: str, value: object) -> list[Out]:
    return [Out(name, value if isinstance(value, Column) else F.lit(value))]


def dated(business_date: Column | None, name: str = "trade_date") -> list[Out]:
    """The row's trade date, which must equal the batch date when one is given."""
    value = sc.strict_date(name)
    bad = value.isNull() if business_date is None else ~value.eqNullSafe(business_date)
    return [Out(name, value, bad, f"wrong {name}")]


@dataclass(frozen=True)
class Cleaned:
    """A typed projection of a raw frame, not yet split into good and bad rows."""

    source: DataFrame
    outs: list[Out]
    keep: Sequence[str]

    def _columns(self) -> list[Column | str]:
        return [*self.keep, *[o.value.alias(o.name) for o in self.outs]]

    def rows(self) -> DataFrame:
        """Rows that pass every column's check.

        The checks are separate conjuncts ahead of the projection: one expression over all
        columns would make the optimizer derive a constraint for every subset of them.
        """
        good = self.source
        for out in self.outs:
            if out.bad is not None:
                good = good.where(~F.coalesce(out.bad, F.lit(False)))
        return good.select(*self._columns())

    def judged(self) -> DataFrame:
        """All rows, with the first reason against them in ``_bad``."""
        checks = [(o.bad, o.why) for o in self.outs if o.bad is not None]
        reason = sc.reject_reason(*checks) if checks else F.lit(None).cast("string")
        return self.source.select(*self._columns(), reason.alias(BAD))

    def rejects(self) -> DataFrame:
        """The rows that do not pass, with the first reason in ``_bad``."""
        return self.judged().where(F.col(BAD).isNotNull())


def cleaned(df: DataFrame, *groups: Sequence[Out | Parsed], keep: Sequence[str] = ()) -> Cleaned:
    """Resolve the output columns against the source types; extra raw columns can be kept."""
    schema = df.schema
    return Cleaned(df, [o.resolve(schema) if isinstance(o, Parsed) else o for group in groups for o in group], keep)


@dataclass
class Check:
    """A frame that must be empty, or whose verdict column must be true everywhere.

    Frames are given as functions: a check that is not run costs no plan analysis.
    """

    frame: Callable[[], DataFrame]
    message: str
    verdict: str | None = None


@dataclass
class Prepared:
    """Rows ready to publish, the checks they depend on, and the frames worth reporting."""

    rows: DataFrame
    checks: list[Check] = field(default_factory=list)
    reports: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    required: list[tuple[DataFrame, str]] = field(default_factory=list)

    def verify(self) -> "Prepared":
        """Run all checks as one job and raise on the first that fails.

        Each check contributes at most one row, so the driver sees a handful of rows and the
        checks share their scans and shuffles.
        """
        parts = []
        for place, check in enumerate(self.checks):
            frame = check.frame()
            bad = frame.where(~F.col(check.verdict)) if check.verdict else frame
            parts.append(bad.limit(1).select(
                F.lit(place).alias("place"), F.lit(check.message).alias("message"), F.to_json(F.struct(*bad.columns)).alias("example")))
        for place, (frame, message) in enumerate(self.required, len(parts)):
            none = frame.limit(1).agg(F.count("*").alias("n")).where("n = 0")
            parts.append(none.select(F.lit(place).alias("place"), F.lit(message).alias("message"), F.lit("no rows").alias("example")))
        if parts:
            failed = reduce(lambda a, b: a.unionByName(b), parts).collect()
            if failed:
                first = min(failed)
                raise QualityError(f"{first['message']}: {first['example']}")
        return self

    def report(self, name: str) -> DataFrame:
        return self.reports[name]()


def usable(clean: Cleaned, name: str, keep: Keep | None = None) -> tuple[DataFrame, Check]:
    """Clean rows, and the check that there were no others; with ``keep`` both read one written judgement of the feed."""
    message = f"{name}: invalid rows"
    if keep is None:
        return clean.rows(), Check(clean.rejects, message)
    judged = keep(clean.judged(), name)
    return judged.where(F.col(BAD).isNull()).drop(BAD), Check(lambda: judged.where(F.col(BAD).isNotNull()), message)


def unique(df: DataFrame, keys: Sequence[str], name: str) -> Check:
    return Check(lambda: qa.natural_key_violations(df, keys), f"{name}: key not unique")
