import itertools
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tapeloom import types as tt
from tapeloom.errors import QueryError
from tapeloom.functions import predicates as pr
from tapeloom.functions import scalar as sc
from tests.conftest import rows


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [(" a\0 ", "a"), ("  ", None), ("\0", None), (None, None), ("A股", "A股")])
def test_clean_text(spark, value, want):
    assert one(spark, value, sc.clean_text("c")) == want


@pytest.mark.parametrize("value, want", [
    ("20240229", date(2024, 2, 29)), ("20230229", None), ("2024-01-01", None), ("202401", None), (" 20240101 ", date(2024, 1, 1)), ("", None)])
def test_strict_date(spark, value, want):
    assert one(spark, value, sc.strict_date("c")) == want


@pytest.mark.parametrize("value, want", [
    (1.0000005, Decimal("1.000001")), (-1.0000005, Decimal("-1.000001")), (0.1, Decimal("0.100000")), (float("nan"), None), (float("inf"), None)])
def test_decimal_of_doubles(spark, value, want):
    assert one(spark, value, sc.decimal_value("c"), "double") == want
    assert one(spark, value, sc.decimal_value("c", text=False), "double") == want


def test_scaling_and_integers(spark):
    assert one(spark, 12.345, sc.scaled("c", 10_000), "double") == Decimal("123450.0000")
    assert one(spark, "3.0", sc.exact_integer("c")) == 3
    assert one(spark, "3.5", sc.exact_integer("c")) is None


@pytest.mark.parametrize("value, want", [("1", True), ("0.0", False), ("1.0", True), ("2", None), ("x", None)])
def test_flag(spark, value, want):
    assert one(spark, value, sc.flag("c")) is want


@pytest.mark.parametrize("value, want", [("93015", "09:30:15"), ("09:30:15", "09:30:15"), ("150000", "15:00:00"), ("256060", None), (None, None)])
def test_clock(spark, value, want):
    assert one(spark, value, sc.clock("c")) == want


@pytest.mark.parametrize("value, want", [
    ("2024-01-02 09:30:00", "2024-01-02 09:30:00"), ("20240102 09:30:00", "2024-01-02 09:30:00"), ("20240102093000", "2024-01-02 09:30:00"),
    ("09:30:00", "2024-05-06 09:30:00"), ("093000", "2024-05-06 09:30:00"), (None, "2024-05-06 22:30:00"), ("soon", None)])
def test_capture_time(spark, value, want):
    got = one(spark, value, sc.capture_time("c", F.lit("2024-05-06").cast("date")))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("value, want", [
    ('["a", "b"]', ["a", "b"]), ("{a, b,}", ["a", "b"]), ("a,b", ["a", "b"]), ("5", ["5"]), ('{"k":1}', ['{"k":1}']), ("", None)])
def test_json_list(spark, value, want):
    assert one(spark, value, sc.json_list("c")) == want


def test_scope_param_takes_the_first(spark):
    assert one(spark, "a=1;hot_type=x;hot_type=y", sc.scope_param("c", "hot_type")) == "x"
    assert one(spark, "a=1", sc.scope_param("c", "hot_type")) is None


def test_recode_and_scope_key(spark):
    assert one(spark, "SH", sc.recode("c", {"SH": "SSE"})) == "SSE"
    assert one(spark, "XX", sc.recode("c", {"SH": "SSE"})) is None
    day = F.lit("2024-03-05").cast("date")
    assert one(spark, "w", sc.scope_key("c", day, by_month=("w",), by_date=("d",))) == "2024-03"
    assert one(spark, "m", sc.scope_key("c", day, by_month=("w",), by_date=("d",))) == "GLOBAL"


def test_change_is_recomputed_and_corrections_named(spark):
    df = spark.createDataFrame([(Decimal("11"), Decimal("10"), Decimal("1"), Decimal("10")), (Decimal("11"), Decimal("10"), Decimal("2"), Decimal("9"))],
                               "close decimal(20,6), pre_close decimal(20,6), sc decimal(20,6), sp decimal(14,6)")
    got = df.select(sc.pct_change("close", "pre_close").alias("p"), sc.correction_flags("close", "pre_close", "sc", "sp").alias("f")).collect()
    assert [r["p"] for r in got] == [Decimal("10.000000")] * 2
    assert [r["f"] for r in got] == [[], ["change", "pct_chg"]]


def test_zero_guards(spark):
    assert one(spark, 1.0, sc.ratio("c", F.lit(0)), "double") is None
    assert one(spark, 0.0, sc.pct_change(F.lit(1).cast(tt.PRICE), F.col("c").cast(tt.PRICE)), "double") is None


# ---------------------------------------------------------------- predicates

CAT = pr.Catalogue()


def test_predicates_follow_the_whitelist(spark):
    df = spark.createDataFrame([("A", Decimal("5")), ("B", None), ("C", Decimal("9"))], "name string, pe decimal(20,6)")
    pick = lambda *f, match="all": [r["name"] for r in df.where(CAT.combine(f, match)).orderBy("name").collect()]
    F_ = pr.Filter
    assert pick(F_("valuation.pe", "gte", "5")) == ["A", "C"]
    assert pick(F_("valuation.pe", "ne", 5)) == ["C"]
    assert pick(F_("valuation.pe", "is_null", True)) == ["B"]
    assert pick(F_("valuation.pe", "between", [4, 6]), F_("stock.name", "eq", "A")) == ["A"]
    assert pick(F_("valuation.pe", "lt", 6), F_("stock.name", "in", ["B", "C"]), match="any") == ["A", "B", "C"]


@pytest.mark.parametrize("item, code", [
    (pr.Filter("stock.secret", "eq", 1), "UNSUPPORTED_FIELD"), (pr.Filter("valuation.pe", "eq", "abc"), "INVALID_FILTER_VALUE"),
    (pr.Filter("valuation.pe", "like", 1), "INVALID_REQUEST"), (pr.Filter("market.limit_status", "eq", "x"), "INVALID_FILTER_VALUE"),
    (pr.Filter("valuation.pe", "between", [1]), "INVALID_FILTER_VALUE")])
def test_bad_filters_are_refused(spark, item, code):
    with pytest.raises(QueryError) as err:
        CAT.predicate(item)
    assert err.value.code == code


def test_bounds(spark):
    with pytest.raises(QueryError):
        CAT.combine([pr.Filter("valuation.pe", "gt", 1)] * 21)
    with pytest.raises(QueryError):
        CAT.ordering([pr.Sort("valuation.pe")] * 6)
    with pytest.raises(QueryError):
        pr.date_range("d", "2024-02-01", "2024-01-01")
    assert len(pr.SCREEN_FIELDS) == 47


def test_text_match_has_no_pattern_characters(spark):
    df = spark.createDataFrame([("10%_x",), ("10ab",), (None,)], "c string")
    assert rows(df.where(pr.text_match("0%_", "c"))) == [("10%_x",)]


def test_sort_puts_nulls_like_the_declared_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "limit_status int")
    down = [r[0] for r in df.orderBy(*CAT.ordering([pr.Sort("market.limit_status")])).collect()]
    up = [r[0] for r in df.orderBy(*CAT.ordering([pr.Sort("market.limit_status", "asc")])).collect()]
    assert down == [None, 2, 1] and up == [1, 2, None]


def test_bare_texts_and_dates_equal_the_cleaned_ones(spark):
    """What is not searched for white space or parsed by a pattern gives the same as what is."""
    texts = ["".join(p) for n in range(4) for p in itertools.product("\0 \x1f\x7f\x85\u3000a!~\u00e9\U0001F600", repeat=n)]
    days = [f"{y:04d}{m:02d}{d:02d}{end}" for y in (0, 1, 1582, 1900, 2000, 2023, 9999) for m in (0, 2, 4, 10, 13) for d in (0, 1, 5, 14, 28, 29, 30, 31) for end in ("", "\n", "a")]
    df = spark.createDataFrame([(t,) for t in [*texts, *days, None]], "c string")
    text = F.nullif(F.btrim(F.replace("c", F.lit("\0"), F.lit("")), F.lit(sc.BLANKS)), F.lit(""))
    day = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    differ = df.where(~text.eqNullSafe(sc.clean_text("c")) | ~day.eqNullSafe(sc.strict_date("c")))
    assert differ.count() == 0 and df.where(day.isNotNull()).count() > 200
