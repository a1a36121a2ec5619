"""Scalar transforms. Every function takes and returns Columns, so all stay in codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import types as tt


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---------------------------------------------------------------- text, dates, numbers


# The characters that count as white space at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_text(value: Column | str) -> Column:
    """Drop NUL characters, strip white space of any kind; empty text becomes NULL.

    Text that begins and ends with a printable ASCII character has nothing to strip and is not searched for white space.
    """
    raw = _col(value).cast("string")
    text = F.replace(raw, F.lit("\0"), F.lit(""))
    bare = F.substring(raw, 1, 1).between("!", "~") & F.substring(raw, -1, 1).between("!", "~")
    return F.when(bare, text).otherwise(F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit("")))


def strict_date(value: Column | str) -> Column:
    """``yyyyMMdd`` text to a date; anything else is NULL. Eight bare digits are not cleaned first, nor parsed by a pattern."""
    raw = _col(value).cast("string")
    text = clean_text(raw)
    iso = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(raw.rlike(r"\A[0-9]{8}\z"), iso.try_cast("date")).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def decimal_value(value: Column | str, dtype: T.DecimalType = tt.PRICE, *, text: bool = True) -> Column:
    """Decimal of the shortest text form; blank, invalid, NaN and infinite are NULL.

    ``text=False`` is for numeric sources: a double casts to the decimal of its shortest
    form directly, without the detour over a string.
    """
    return (clean_text(value) if text else _col(value)).try_cast(dtype)


def scaled(value: Column | str, factor: int, dtype: T.DecimalType = tt.QUANTITY, *, text: bool = True) -> Column:
    """Bring a provider unit (lots, thousands, 1e4, 1e8) to single units."""
    exact = decimal_value(value, T.DecimalType(27, 9), text=text)
    return (exact * F.lit(factor).cast(T.DecimalType(10, 0))).cast(dtype)


def exact_integer(value: Column | str, *, text: bool = True) -> Column:
    """Whole numbers only: 3 and 3.0 pass; 3.5 is NULL, and so is any other fraction a 38-digit decimal can hold."""
    number = decimal_value(value, T.DecimalType(38, 18), text=text)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def flag(value: Column | str) -> Column:
    """0/1 in any numeric or text spelling."""
    number = clean_text(value).try_cast("double")
    return F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False))


def clock(value: Column | str) -> Column:
    """``HHMMSS`` or ``HH:MM:SS``, left-padded with zeros, as ``HH:mm:ss`` text."""
    digits = F.replace(clean_text(value), F.lit(":"), F.lit(""))
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    valid = padded.rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$")
    parts = F.concat_ws(
        ":", F.substring(padded, 1, 2), F.substring(padded, 3, 2), F.substring(padded, 5, 2)
    )
    return F.when(valid, parts)


def capture_time(value: Column | str, trade_date: Column | str) -> Column:
    """Local capture time of a feed row.

    Accepts full timestamps in three spellings, or a bare clock combined with the trade
    date; a missing value means the 22:30 close of day.
    """
    text = F.coalesce(clean_text(value), F.lit("22:30:00"))
    shape = r"^((\d{4}-\d{2}-\d{2}|\d{8}) \d{1,2}:\d{2}:\d{2}|\d{14}|\d{1,2}:\d{2}:\d{2}|\d{5,6})$"
    own_day = F.regexp_extract(text, r"^(\d{4}-?\d{2}-?\d{2})(?= |\d{6}$)", 1)
    day = F.when(own_day != "", F.replace(own_day, F.lit("-"), F.lit(""))).otherwise(
        F.date_format(_col(trade_date).cast("timestamp_ntz"), "yyyyMMdd"))
    time = F.replace(F.regexp_extract(text, r"(\d{1,2}:?\d{2}:?\d{2})$", 1), F.lit(":"), F.lit(""))
    digits = F.concat(day, F.lpad(time, 6, "0"))
    iso = F.regexp_replace(digits, r"^(.{4})(..)(..)(..)(..)(..)$", "$1-$2-$3 $4:$5:$6")
    return F.when(text.rlike(shape), iso).try_cast("timestamp_ntz")


def to_utc(local: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """Wall-clock timestamp of ``zone`` as an instant."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(local))


def json_list(value: Column | str) -> Column:
    """JSON array, JSON scalar or ``{a,b}`` / ``a,b`` text as an array of strings."""
    text = clean_text(value)
    inner = F.when(
        text.startswith("{") & text.endswith("}"), F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
    ).otherwise(text)
    pieces = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return (
        F.when(text.isNull(), F.lit(None).cast("array<string>"))
        .when(parsed.isNull(), pieces)
        .when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<string>"))
        .when(kind.startswith("OBJECT"), F.array(F.to_json(parsed)))
        .otherwise(F.array(F.try_variant_get(parsed, "$", "string")))
    )


def scope_param(scope_key: Column | str, name: str) -> Column:
    """One parameter of a ``k=v;k=v`` scope key; the first occurrence wins."""
    pairs = F.filter(F.split(_col(scope_key), ";"), lambda p: p.startswith(f"{name}="))
    return F.substr(F.try_element_at(pairs, F.lit(1)), F.lit(len(name) + 2))


# ---------------------------------------------------------------- recoding and keys


def recode(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; codes outside the map are NULL."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(value))


def relabel(value: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Literal map lookup with a default, for display labels."""
    label = recode(value, mapping)
    return F.coalesce(label, F.lit(default)) if default is not None else F.coalesce(label, _col(value))


def month_start(day: Column | str) -> Column:
    return F.trunc(_col(day), "MM")


def next_month(day: Column | str) -> Column:
    return F.add_months(month_start(day), 1)


def month_key(day: Column | str) -> Column:
    return F.date_format(_col(day).cast("timestamp_ntz"), "yyyy-MM")


def day_key(day: Column | str) -> Column:
    return F.date_format(_col(day).cast("timestamp_ntz"), "yyyy-MM-dd")


def scope_key(
    dataset: Column | str,
    day: Column | str,
    *,
    by_date: tuple[str, ...] = (),
    by_month: tuple[str, ...] = (),
    by_entity: tuple[str, ...] = (),
) -> Column:
    """Release scope key of a dataset: GLOBAL, ISO day or ``YYYY-MM``."""
    name = _col(dataset)
    key = F.when(name.isin(*by_date, *by_entity), day_key(day))
    if by_month:
        key = key.when(name.isin(*by_month), month_key(day))
    return key.otherwise(F.lit("GLOBAL"))


# ---------------------------------------------------------------- arithmetic


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL instead of an error when the denominator is zero."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def duration_ms(started: Column | str, finished: Column | str, now: Column) -> Column:
    """Elapsed milliseconds, never negative; NULL when not started."""
    start = _col(started).cast("timestamp")
    end = F.coalesce(_col(finished).cast("timestamp"), now.cast("timestamp"))
    return F.when(start.isNotNull(), F.greatest(F.lit(0), F.unix_millis(end) - F.unix_millis(start)))


def price_change(close: Column | str, pre_close: Column | str) -> Column:
    return (_col(close) - _col(pre_close)).cast(tt.PRICE)


def pct_change(close: Column | str, pre_close: Column | str) -> Column:
    """Percent move, rounded half-up at six decimals; NULL on a zero base."""
    move = (_col(close) - _col(pre_close)).cast(tt.PRICE)
    return (F.try_divide(move, _col(pre_close)) * 100).cast(tt.RATIO)


def correction_flags(
    close: Column | str, pre_close: Column | str, source_change: Column | str, source_pct: Column | str
) -> Column:
    """Names of the source fields that disagree with the recomputed ones."""
    off_change = F.abs(_col(source_change) - price_change(close, pre_close)) > F.lit(
        tt.PRICE_TOLERANCE
    ).cast(tt.RATIO)
    off_pct = F.abs(_col(source_pct) - pct_change(close, pre_close)) > F.lit(tt.PCT_TOLERANCE).cast(
        tt.RATIO
    )
    return F.array_compact(
        F.array(F.when(off_change, F.lit("change")), F.when(off_pct, F.lit("pct_chg")))
    )


def within(left: Column | str, right: Column | str, tolerance: str = tt.PRICE_TOLERANCE) -> Column:
    return F.abs(_col(left) - _col(right)) <= F.lit(tolerance).cast(T.DecimalType(18, 6))


def first_named(*columns: Column | str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in columns))


def adjusted_columns(adjustment: str) -> dict[str, Column]:
    """Price projection for ``raw``, ``qfq`` or ``hfq`` prices.

    Adjusted prices also recompute ``change`` from the adjusted pair.
    """
    names = ("open", "high", "low", "close", "pre_close")
    if adjustment == "raw":
        picked = {n: F.col(n) for n in names}
        picked["change"] = F.col("change")
        return picked
    picked = {n: F.col(f"{n}_{adjustment}") for n in names}
    picked["change"] = F.col(f"close_{adjustment}") - F.col(f"pre_close_{adjustment}")
    return picked


def json_safe(schema: T.StructType) -> list[Column]:
    """Projection that renders decimals as plain text and dates and times as ISO text."""
    out: list[Column] = []
    for field in schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column.cast("timestamp_ntz"), "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(column.alias(field.name))
    return out


def reject_reason(*checks: tuple[Column, str]) -> Column:
    """First failing check as text, NULL when the row is clean."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks))


def unparsable(source: Column | str, parsed: Column, *, text: bool = True) -> Column:
    """True where the source holds a value that did not parse."""
    return (clean_text(source) if text else _col(source)).isNotNull() & parsed.isNull()
