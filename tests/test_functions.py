"""Scalar rules on hand-made values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadcurve.functions import actions, money, numbers, text


def value(spark, expression):
    return spark.range(1).select(F.expr(expression).alias("x")).first().x


@pytest.mark.parametrize(
    "given, digits, expected",
    [("-12.25D", 1, -12.2), ("12.25D", 1, 12.3), ("-0.5D", 0, 0.0), ("2.5D", 0, 3.0), ("1.005D", 2, 1.0)],
)
def test_half_goes_up(spark, given, digits, expected):
    assert value(spark, numbers.half_up(given, digits)) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "given, expected",
    [("12abc", 12), ("  7", 7), ("-3", -3), ("x1", None), ("", None), ("99999999999", None), ("4.9", 4)],
)
def test_leading_int(spark, given, expected):
    assert value(spark, numbers.leading_int(f"'{given}'")) == expected


@pytest.mark.parametrize("given, expected", [("12", 12), (" 3 ", 3), ("abc", 0), ("NaN", 0), ("", 0), ("7.9", 7)])
def test_count_or_zero(spark, given, expected):
    assert value(spark, numbers.count_or_zero(f"'{given}'")) == expected
    assert value(spark, numbers.count_or_zero("cast(null as string)")) == 0


def test_money_or_zero(spark):
    assert value(spark, numbers.money_or_zero("'12.30'")) == Decimal("12.30")
    assert value(spark, numbers.money_or_zero("'x'")) == 0
    assert value(spark, numbers.money_or_zero("'NaN'")) == 0
    assert value(spark, numbers.money_or_zero("'12345678901.50'")) == Decimal("12345678901.50")
    with pytest.raises(Exception, match="does not fit"):
        value(spark, numbers.money_or_zero("'1e30'"))


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2024/01/05 10:00:00", "2024-01-05 10:00:00"),
        ("2024/1/5", "2024-01-05 00:00:00"),
        ("Fri Jan 05 2024 10:00:00", "2024-01-05 10:00:00"),
        ("Fri Jan 05 2024 10:00:00 GMT-0300 (local)", "2024-01-05 13:00:00"),
        ("Fri Jan 05 2024 10:00:00 GMT", "2024-01-05 10:00:00"),
        ("2024-01-05T10:00:00-03:00", "2024-01-05 13:00:00"),
        ("Fri Xxx 05 2024 10:00:00", None),
        ("Jan 5, 2024", "2024-01-05 00:00:00"),
        ("January 5, 2024 9:05 PM", "2024-01-05 21:05:00"),
        ("Friday, Dec 5, 2024 12:00:01 am", "2024-12-05 00:00:01"),
        ("5 Jan 2024", "2024-01-05 00:00:00"),
        ("05-Mar-2024 10:00", "2024-03-05 10:00:00"),
        ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00"),
        ("Fri, 5 Jan 2024 10:00:00 -0300 (BRT)", "2024-01-05 13:00:00"),
        ("1/5/2024 10:00", "2024-01-05 10:00:00"),
        ("1/5/2024, 12:30:15 PM", "2024-01-05 12:30:15"),
        ("12/31/2024", "2024-12-31 00:00:00"),
        ("13/5/2024", None),
        ("Feb 30, 2024", None),
        ("1/5/2024 13:00 PM", None),
        ("Jan 5, 2024 at noon", None),
        ("5 Xxx 2024", None),
    ],
)
def test_time_text(spark, given, expected):
    assert value(spark, f"cast({text.utc_timestamp(repr(given))} as string)") == expected


def test_time_text_of_a_zone(spark):
    of_zone = text.utc_timestamp("'2024-01-05 10:00:00'", "America/Sao_Paulo")
    assert value(spark, f"cast({of_zone} as string)") == "2024-01-05 13:00:00"
    of_words = text.utc_timestamp("'1/5/2024 10:00 PM'", "America/Sao_Paulo")
    assert value(spark, f"cast({of_words} as string)") == "2024-01-06 01:00:00"
    with_offset = text.utc_timestamp("'2024-01-05 10:00:00+00:00'", "America/Sao_Paulo")
    assert value(spark, f"cast({with_offset} as string)") == "2024-01-05 10:00:00"


@pytest.mark.parametrize(
    "given, kept", [('{"a":1,"a":2}', True), ('{"a":1,"a":2} x', False), ("{'a':1}", False), ('{"it\'s":1,"it\'s":2}', True), ("null", False), ("vv", False), ("1,2", False)]
)
def test_json_text(spark, given, kept):
    literal = "'" + given.replace("'", "\\'") + "'"
    assert value(spark, text.json_text_or_null(literal)) == (given if kept else None)


def test_ratio_without_denominator(spark):
    assert value(spark, numbers.ratio("1", "0")) is None
    assert value(spark, numbers.ratio("1", "cast(null as int)")) is None
    assert value(spark, numbers.ratio("1", "4", 100)) == 25.0


@pytest.mark.parametrize(
    "revenue, sales, expected",
    [
        ("0", 0, "0.00"),
        ("100", 0, "0.00"),
        ("37.90", 1, "33.50"),
        ("54.90", 1, "47.98"),       # one bump
        ("92.80", 2, "81.48"),       # one bump over two sales
        ("30.00", 1, "33.50"),       # below list price: no negative bumps
        ("46.40", 1, "47.98"),       # half a bump rounds up
    ],
)
def test_net_income(spark, revenue, sales, expected):
    got = value(spark, money.net_income(f"cast({revenue} as decimal(18,2))", f"{sales}L"))
    assert got == Decimal(expected)


def test_list_price_fallback(spark):
    assert value(spark, money.revenue_or_list_price("0.00", "3L")) == Decimal("113.70")
    assert value(spark, money.revenue_or_list_price("5.00", "3L")) == Decimal("5.00")


def test_timestamps_are_utc(spark):
    """Whatever the session zone (Tokyo here)."""
    at = lambda s: value(spark, text.utc_timestamp(f"'{s}'"))
    assert at("2024-01-01 00:00:00") == dt.datetime(2024, 1, 1)
    assert at("2024-01-01T00:00:00Z") == dt.datetime(2024, 1, 1)
    assert at(" 2024-01-01T00:00:00.5-03:00 ") == dt.datetime(2024, 1, 1, 3, 0, 0, 500000)
    assert at("bad") is None and at("12:30") is None and at("") is None


def test_json_or_null(spark):
    keep = lambda s: value(spark, text.json_text_or_null(f"'{s}'"))
    assert keep('{"a": 1}') == '{"a": 1}'
    assert keep("v1") is None and keep("null") is None


def test_strip_takes_every_blank(spark):
    assert value(spark, text.strip("concat(char(9), ' a b', char(10), char(160))")) == "a b"


ACTIONS = (
    "array(named_struct('action_type', 'purchase', 'value', '3'), "
    "named_struct('action_type', 'omni_purchase', 'value', '5'), "
    "named_struct('action_type', 'video_view', 'value', '7'), "
    "named_struct('action_type', 'video_view', 'value', '2'), "
    "named_struct('action_type', 'other', 'value', 'abc'))"
)


def test_actions(spark):
    assert value(spark, actions.largest_of(ACTIONS, ["purchase", "omni_purchase"])) == 5
    assert value(spark, actions.total_of(ACTIONS, "video_view")) == 9
    assert value(spark, actions.total_count(ACTIONS)) == 17
    assert value(spark, actions.largest_of(ACTIONS, ["missing"])) == 0
    nothing = "cast(null as array<struct<action_type:string,value:string>>)"
    assert value(spark, actions.total_count(nothing)) == 0
    assert value(spark, actions.largest_of(nothing, ["purchase"])) == 0
