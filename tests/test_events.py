"""Cleaning and validation of pings and costs."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import SF
from pyspark.sql import functions as F

from leadcurve.operators import events as ev
from leadcurve.operators import funnel as fn
from leadcurve.operators import periods
from leadcurve.sources import driver_tables as drv
from leadcurve.sources import schemas


def row(i, **changes):
    base = dict(ts="2024-01-01 12:00:00", sessao="abcd", tipo="etapa", etapa="3", data="v1", pagina="v2")
    base.update(changes)
    return (i, *(base[k] for k in ("ts", "sessao", "tipo", "etapa", "data", "pagina")))


def reasons(table, rows, **options):
    raw = table(schemas.EVENT_SHEET, *[row(i, **r) for i, r in enumerate(rows)])
    checked = ev.clean_events(raw, **options)
    return {r.id: r for r in checked.collect()}


def test_reject_reasons_in_order(table):
    got = reasons(
        table,
        [
            {"sessao": "abc", "tipo": "x"},       # session is checked first
            {"sessao": " abcd "},
            {"sessao": "s" * 64},
            {"sessao": "s" * 65},
            {"tipo": "x", "etapa": "0"},
            {"tipo": ""},                         # default type
            {"tipo": "  "},                       # default comes before trimming
            {"etapa": "0"},
            {"etapa": "41", "ts": "bad"},
            {"etapa": "40"},
            {"ts": "bad"},
            {"tipo": "respostas", "etapa": ""},
            {"tipo": None, "sessao": None},
        ],
    )
    expected = ["sessao", None, None, "sessao", "tipo", None, "tipo", "etapa", "etapa", None, "ts", None, "sessao"]
    assert [got[i].motivo for i in range(len(expected))] == expected
    assert got[1].sessao == "abcd" and got[5].tipo == "etapa"


def test_typed_columns(table):
    got = reasons(
        table,
        [
            {"data": "x" * 25},
            {"data": " "},
            {"tipo": "respostas", "data": '{"a": 1}', "etapa": "12abc"},
            {"tipo": "respostas", "data": "{broken"},
            {"pagina": " "},
        ],
    )
    assert got[0].variante == "x" * 24 and got[0].dados is None
    assert got[1].variante is None
    assert (got[2].dados, got[2].variante, got[2].etapa) == ('{"a": 1}', None, 12)
    assert got[3].dados is None and got[3].motivo is None
    assert got[4].pagina is None


def test_table_checks(table):
    rows = [
        {"tipo": "respostas", "etapa": "41", "data": "{}"},
        {"pagina": "p" * 25},
        {"pagina": "p" * 24},
        {"tipo": "respostas", "etapa": "", "data": "{}"},
    ]
    assert [r.motivo for r in reasons(table, rows).values()] == [None] * 4
    strict = reasons(table, rows, table_checks=True)
    assert [strict[i].motivo for i in range(4)] == ["etapa", "pagina", None, None]


def test_typed_rows_against_the_table(table):
    rows = table(
        "id int, sessao string, tipo string, etapa int, variante string, pagina string",
        (1, "abcd", "etapa", 40, "v" * 24, "p" * 24),
        (2, "abcd", "etapa", None, None, None),
        (3, "abc", "etapa", 1, None, None),
        (4, "abcd", None, 1, None, None),
        (5, "abcd", "respostas", 0, None, None),
        (6, "abcd", "etapa", 1, "v" * 25, None),
        (7, "abcd", "etapa", 1, None, "p" * 25),
    )
    got = {r.id: r.motivo for r in ev.check_events(rows).collect()}
    assert got == {1: None, 2: None, 3: "sessao", 4: "tipo", 5: "etapa", 6: "variante", 7: "pagina"}


def test_counts_cover_every_row(table):
    raw = table(schemas.EVENT_SHEET, row(1), row(2, sessao="x"), row(3, ts="?"))
    counts = {r.motivo: r.linhas for r in ev.reject_counts(ev.clean_events(raw)).collect()}
    assert counts == {"ok": 1, "sessao": 1, "ts": 1}


def test_accepted_equals_valid(table):
    raw = table(schemas.EVENT_SHEET, row(1), row(2, sessao="x"), row(3, tipo="respostas", data="{}"))
    cleaned = ev.clean_events(raw)
    got = ev.accepted(cleaned)
    assert got.dtypes == ev.valid(cleaned).dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ev.valid(cleaned).collect()))
    assert {r.id for r in ev.rejected(cleaned).collect()} == {2}


def test_pings(table):
    at = dt.datetime(2024, 1, 1)
    pings = table(
        schemas.PING,
        (1, at, None, "abcd", "3", "1", None, None),
        (2, at, None, "abcd", "3", "", None, None),
        (3, at, "respostas", "abcd", None, "1", '{"a":1}', "tiktok"),
        (4, at, None, "abcd", "", None, None, None),        # neither stage nor answers
        (5, at, "other", "abcd", None, None, None, None),
    )
    rows = {r.id: r for r in ev.ping_to_row(pings).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].tipo, rows[1].data) == ("etapa", "v1")
    assert rows[2].data == "v0"
    assert (rows[3].tipo, rows[3].data, rows[3].etapa) == ("respostas", '{"a":1}', "")
    assert (rows[1].pagina, rows[3].pagina) == (None, "tiktok")
    assert ev.ping_to_row(pings.drop("pagina")).first().pagina is None


def test_times_by_their_type(spark, table):
    """The session's zone, Tokyo here, plays no part."""
    raw = table(schemas.EVENT_SHEET, row(1))
    instant = raw.withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00Z'"))
    got = ev.clean_events(instant)
    assert dict(got.dtypes)["ts"] == "timestamp_ntz" and str(got.first().ts) == "2024-01-01 00:00:00"
    with pytest.raises(TypeError):
        ev.clean_events(raw.withColumn("ts", F.lit(5)))
    for call in (fn.sessions_by_period, fn.pings_by_period):
        with pytest.raises(TypeError):
            call(instant, periods.presets(dt.date(2024, 1, 30)))


def test_closed_presets_read_their_hull(spark):
    events = drv.events(spark, SF)
    named = {k: p for k, p in periods.presets(dt.date(2024, 1, 30)).items() if k in ("7d", "ontem")}
    plan = fn.pings_by_period(events, named)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-24T03:00)" in plan
    assert periods.hull(named) == periods.Period(dt.date(2024, 1, 24), dt.date(2024, 1, 30))
    assert periods.hull(periods.presets(dt.date(2024, 1, 30))) == periods.EVERYTHING


def test_costs(table):
    costs = table(
        schemas.COSTS,
        ("1", " ", Decimal("1.00"), None),
        ("2", "x" * 121, Decimal("1.00"), None),
        ("3", "x", Decimal("-0.01"), None),
        ("4", None, Decimal("0.00"), None),
        ("5", " x ", Decimal("0.00"), None),
    )
    got = {r.id: r.motivo for r in ev.check_costs(costs).collect()}
    assert got == {"1": "nome", "2": "nome", "3": "valor", "4": "nome", "5": None}


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "d int, n string")
    assert [tuple(r) for r in ev.repeated_keys(df, "d", "n").collect()] == [(1, "a", 2)]
