"""Screening predicates over a field whitelist, universe filters and text search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.errors import QueryError

MAX_FILTERS, MAX_FIELDS, MAX_SORTS, MAX_IN = 20, 50, 5, 100

_TEXT, _NUMBER, _WHOLE = "string", "number", "integer"


@dataclass(frozen=True)
class Field:
    """A screenable column: value type, unit and the table it lives in."""

    column: str
    kind: str
    unit: str | None = None
    nullable: bool = True


def _fields(group: str, kind: str, names: str, unit: str | None = None, nullable: bool = True) -> dict[str, Field]:
    return {f"{group}.{n}": Field(n, kind, unit, nullable) for n in names.split()}


# The whitelist of screenable fields.
SCREEN_FIELDS: dict[str, Field] = {
    **_fields("stock", _TEXT, "ts_code name", nullable=False),
    **_fields("stock", _TEXT, "area industry market"),
    **_fields("stock", _TEXT, "exchange list_status", nullable=False),
    **_fields("stock", _TEXT, "is_hs"),
    **_fields("market", _NUMBER, "open high low close", "CNY", nullable=False),
    **_fields("market", _NUMBER, "pct_chg", "percent", nullable=False),
    **_fields("market", _NUMBER, "volume", "share", nullable=False),
    **_fields("market", _NUMBER, "amount", "CNY", nullable=False),
    **_fields("market", _NUMBER, "turnover_rate turnover_rate_f", "percent"),
    **_fields("market", _NUMBER, "volume_ratio"),
    **_fields("market", _WHOLE, "limit_status"),
    **_fields("valuation", _NUMBER, "pe pe_ttm pb ps ps_ttm"),
    **_fields("valuation", _NUMBER, "dv_ratio dv_ttm", "percent"),
    **_fields("valuation", _NUMBER, "total_mv circ_mv", "CNY"),
    **_fields("technical", _NUMBER, "macd_dif macd_dea macd", "CNY"),
    **_fields("technical", _NUMBER, "kdj_k kdj_d kdj_j rsi_6 rsi_12 rsi_24"),
    **_fields("technical", _NUMBER, "boll_upper boll_mid boll_lower", "CNY"),
    **_fields("technical", _NUMBER, "cci"),
    **_fields("moneyflow", _NUMBER, "net_mf_vol", "share"),
    **_fields(
        "moneyflow", _NUMBER,
        "net_mf_amount buy_lg_amount sell_lg_amount buy_elg_amount sell_elg_amount", "CNY",
    ),
}

# Default projection of the screener.
DEFAULT_SCREEN_FIELDS = (
    "stock.ts_code", "stock.name", "stock.industry", "market.close", "market.pct_chg", "market.amount",
    "market.turnover_rate", "valuation.pe_ttm", "valuation.pb", "valuation.total_mv",
)


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Universe:
    list_status: Sequence[str] = ("L",)
    exchanges: Sequence[str] | None = None
    markets: Sequence[str] | None = None
    industries: Sequence[str] | None = None
    is_hs: Sequence[str] | None = None
    exclude_suspended: bool = True


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "desc"


@dataclass(frozen=True)
class Catalogue:
    """Field lookup used to turn user input into Columns."""

    fields: dict[str, Field] = field(default_factory=lambda: dict(SCREEN_FIELDS))

    def column(self, name: str) -> Column:
        if name not in self.fields:
            raise QueryError("UNSUPPORTED_FIELD", "field is not screenable", field=name)
        return F.col(self.fields[name].column)

    def literal(self, name: str, value: object) -> Column:
        """User value as a typed literal of the field's kind."""
        kind = self.fields[name].kind
        try:
            if kind == _TEXT:
                return F.lit(str(value))
            if kind == _WHOLE:
                return F.lit(int(value))  # type: ignore[call-overload]
            number = Decimal(str(value))
            if not number.is_finite():
                raise ValueError("not a finite number")
            return F.lit(number)
        except (TypeError, ValueError, InvalidOperation) as exc:
            raise QueryError("INVALID_FILTER_VALUE", str(exc), field=name, value=value) from exc

    def predicate(self, item: Filter) -> Column:
        column = self.column(item.field)
        if item.op == "is_null":
            return column.isNull() if item.value else column.isNotNull()
        if item.op in ("between", "in"):
            values = list(item.value) if isinstance(item.value, (list, tuple)) else []
            if not values or len(values) > MAX_IN or (item.op == "between" and len(values) != 2):
                raise QueryError("INVALID_FILTER_VALUE", "bad value list", field=item.field)
            literals = [self.literal(item.field, v) for v in values]
            return column.between(*literals) if item.op == "between" else column.isin(*literals)
        if item.value is None:
            raise QueryError("INVALID_FILTER_VALUE", "value required", field=item.field)
        value = self.literal(item.field, item.value)
        comparisons = {
            "eq": column == value, "ne": column != value, "gt": column > value,
            "gte": column >= value, "lt": column < value, "lte": column <= value,
        }
        if item.op not in comparisons:
            raise QueryError("INVALID_REQUEST", "unknown operator", operator=item.op)
        return comparisons[item.op]

    def combine(self, filters: Sequence[Filter], match: str = "all") -> Column:
        if len(filters) > MAX_FILTERS:
            raise QueryError("INVALID_REQUEST", "too many filters")
        if match not in ("all", "any"):
            raise QueryError("INVALID_REQUEST", "match must be all or any")
        if not filters:
            return F.lit(True)
        columns = [self.predicate(f) for f in filters]
        return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), columns)

    def ordering(self, sorts: Sequence[Sort]) -> list[Column]:
        """Sort keys with NULL first on descending and last on ascending keys."""
        if len(sorts) > MAX_SORTS:
            raise QueryError("INVALID_REQUEST", "too many sort keys")
        return [
            self.column(s.field).asc_nulls_last() if s.direction == "asc" else self.column(s.field).desc_nulls_first()
            for s in sorts
        ]


def universe_predicate(universe: Universe) -> Column:
    """Master-table part of a screen."""
    choices = {
        "list_status": universe.list_status, "exchange": universe.exchanges, "market": universe.markets,
        "industry": universe.industries, "is_hs": universe.is_hs,
    }
    parts = [F.col(name).isin(*values) for name, values in choices.items() if values]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def text_match(term: str, *columns: str) -> Column:
    """Case-insensitive substring over several columns; no pattern characters to escape."""
    needle = F.lower(F.lit(term))
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns],
    )


def prefix_match(term: str, column: str) -> Column:
    return F.coalesce(F.startswith(F.lower(F.col(column)), F.lower(F.lit(term))), F.lit(False))


def date_range(column: str, start: str | None, end: str | None) -> Column:
    """Optional bounds on a date column."""
    if start and end and start > end:
        raise QueryError("INVALID_REQUEST", "start cannot be later than end")
    parts = []
    if start:
        parts.append(F.col(column) >= F.lit(start).cast("date"))
    if end:
        parts.append(F.col(column) <= F.lit(end).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def ohlc_invalid(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Non-positive prices, or a low/high that does not bracket open and close."""
    o, h, lo, c = (F.col(x) for x in (open_, high, low, close))
    return (
        (F.least(o, h, lo, c) <= 0) | (lo > F.least(o, c)) | (h < F.greatest(o, c))
    )


def not_like_any(column: str, patterns: Sequence[str]) -> Column:
    """Rows whose text matches none of the LIKE patterns (NULL text does not pass)."""
    return ~reduce(lambda a, b: a | b, [F.col(column).like(p) for p in patterns])
