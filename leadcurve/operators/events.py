"""Ping normalisation, cleaning and validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.constants import (
    COST_NAME_LENGTH,
    EVENT_TYPES,
    MAX_STAGE,
    PAGE_LENGTH,
    SESSION_LENGTH,
    VARIANT_LENGTH,
)
from leadcurve.functions.numbers import clamped_leading_int
from leadcurve.functions.text import (
    empty_to_null,
    json_text_or_null,
    or_else,
    strip,
    utc_of_instant,
    utc_timestamp,
)
from leadcurve.operators.periods import Period, within_local_period


def ping_to_row(pings: DataFrame) -> DataFrame:
    """Request parameters to a raw event row (all text but the arrival time).

    A request counts when it carries a stage or delivers answers. Answers
    keep their JSON in ``data``; stage pings keep the headline variant there.
    """
    answers, variant = "action <=> 'respostas'", or_else("v", "'0'")
    return pings.where(f"{answers} or etapa != ''").selectExpr(
        "id",
        "recebido as ts",
        "coalesce(sessao, '') as sessao",
        f"if({answers}, 'respostas', 'etapa') as tipo",
        "coalesce(etapa, '') as etapa",
        f"if({answers}, coalesce(data, ''), concat('v', {variant})) as data",
        "pagina" if "pagina" in pings.columns else "cast(null as string) as pagina",
    )


def _absent_or_outside(value: str, low: int, high: int) -> str:
    return f"not coalesce({value} between {low} and {high}, false)"


def utc_time(raw: DataFrame, column: str = "ts", zone: str = "UTC") -> str:
    """Expression of a time column as zone-less UTC, by its type.

    A zone-less timestamp is UTC already, one with time zone is moved to UTC,
    text is read (see ``utc_timestamp``); any other type is refused. The
    session's zone plays no part.
    """
    kind = dict(raw.dtypes)[column]
    if kind == "timestamp_ntz":
        return column
    if kind == "timestamp":
        return utc_of_instant(column)
    if kind == "string":
        return utc_timestamp(column, zone)
    raise TypeError(f"{column} must hold a time or text, not {kind}")


def clean_events(
    raw: DataFrame, table_checks: bool = False, cut_variant: bool = True, zone: str = "UTC"
) -> DataFrame:
    """Raw text rows to typed events with a ``motivo`` (reject reason, null = good).

    Checks run in the order session, type, stage, timestamp. With
    ``table_checks`` the stored table's own limits follow: stage 1..40 for
    every type, variant and page length. History is stored with its variants
    cut to the limit; without ``cut_variant`` a longer one is left for the
    table's check to refuse. ``zone`` is that of time text without an offset.
    """
    types = dict(raw.dtypes)
    ts = utc_time(raw, "ts", zone)
    variant = f"substring(_extra, 1, {VARIANT_LENGTH})" if cut_variant else "_extra"
    page = empty_to_null(strip("pagina")) if "pagina" in types else "cast(null as string)"
    kind = strip(or_else("tipo", "'etapa'"))
    trimmed = raw.selectExpr(
        "id",
        f"{ts} as ts",
        f"coalesce({strip('sessao')}, '') as sessao",
        f"{kind} as tipo",
        f"{clamped_leading_int('etapa')} as etapa",
        f"{page} as pagina",
        f"{empty_to_null(strip('data'))} as _extra",
    )
    typed = trimmed.selectExpr(
        "id",
        "ts",
        "sessao",
        "tipo",
        "etapa",
        f"case when tipo = 'etapa' then {variant} end as variante",
        "pagina",
        f"case when tipo = 'respostas' then {json_text_or_null('_extra')} end as dados",
    )
    bad_stage = _absent_or_outside("etapa", 1, MAX_STAGE)
    checks = [
        (_absent_or_outside("char_length(sessao)", *SESSION_LENGTH), "sessao"),
        (f"tipo not in {EVENT_TYPES}", "tipo"),
        (f"tipo = 'etapa' and {bad_stage}", "etapa"),
        ("ts is null", "ts"),
    ]
    if table_checks:
        checks += TABLE_CHECKS
    return typed.selectExpr("*", f"{_first_failing(checks)} as motivo")


# limits of the stored event table, for every type of ping
TABLE_CHECKS = [
    (f"tipo is null or tipo not in {EVENT_TYPES}", "tipo"),
    (f"etapa is not null and {_absent_or_outside('etapa', 1, MAX_STAGE)}", "etapa"),
    (_absent_or_outside("char_length(sessao)", *SESSION_LENGTH), "sessao"),
    (f"char_length(variante) > {VARIANT_LENGTH}", "variante"),
    (f"char_length(pagina) > {PAGE_LENGTH}", "pagina"),
]


def raw_bounds(raw: DataFrame, period: Period) -> str | None:
    """A condition on the raw time column that every row of a local period meets, if its type allows one.

    It compares the column as it is stored, so it reaches the scan and the
    files' statistics. Text is ordered like its time only where it begins
    with a date as ISO has it or with slashes; the latter and other
    spellings are let through (by year, or whole), and so are years before
    1900 and from 2100 on. A day is added on both sides, as
    text may name any zone.
    """
    kind = dict(raw.dtypes)["ts"]
    low, high = (day and day + dt.timedelta(days=shift) for day, shift in ((period.start, -2), (period.end, 3)))
    if not low and not high:
        return None
    if kind == "timestamp_ntz":
        return " and ".join(f"ts {sign} timestamp_ntz'{day} 00:00:00'" for sign, day in ((">=", low), ("<", high)) if day)
    if kind == "timestamp":
        return " and ".join(f"ts {sign} timestamp'{day} 00:00:00Z'" for sign, day in ((">=", low), ("<", high)) if day)
    if kind != "string":
        return None
    dashed = " and ".join([f"ts >= '{low}'" if low else "ts >= '0'", f"ts < '{high}'" if high else "ts < ':'"])
    slashed = " and ".join([f"ts >= '{low.year:04d}/'" if low else "ts >= '0'", f"ts < '{high.year:04d}0'" if high else "ts < ':'"])
    # all but what begins with 190-199 or 200-209, the years of events; a day or month in front has its blank, hyphen or slash there, before 0
    return f"({dashed} or {slashed} or ts < '190' or ts >= '2 ' and ts < '200' or ts >= '21')"


def events_of_period(raw: DataFrame, period: Period, **options) -> DataFrame:
    """The valid events of a local period, cleaned; rows that cannot belong to it are left out at the scan."""
    bounds = raw_bounds(raw, period)
    return within_local_period(accepted(clean_events(raw.where(bounds) if bounds else raw, **options)), period)


def check_events(events: DataFrame) -> DataFrame:
    """Adds ``motivo`` to typed pings: the first limit of the event table they break."""
    return events.selectExpr("*", f"{_first_failing(TABLE_CHECKS)} as motivo")


def _first_failing(checks: list[tuple[str, str]]) -> str:
    return f"case {' '.join(f'when {test} then {name!r}' for test, name in checks)} end"


def valid(checked: DataFrame) -> DataFrame:
    return checked.where("motivo is null").drop("motivo")


def accepted(cleaned: DataFrame) -> DataFrame:
    """The valid rows of cleaned events, each cleaned once.

    A plain filter would be moved below the cleaning, by way of repeating
    all its expressions inside the filter. Passing each row through an array
    of one keeps the filter above it (measured: a quarter of the time). The
    same wall stops later filters and column choices: restrict ``raw``
    before cleaning, not what comes out here.
    """
    row = f"inline(array(struct({', '.join(cleaned.columns)})))"
    return valid(cleaned.selectExpr(row))


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("motivo is not null")


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rows per outcome; good rows are counted as ``ok``."""
    outcome = F.expr("coalesce(motivo, 'ok') as motivo")
    return checked.groupBy(outcome).agg(F.count("*").alias("linhas"))


def check_costs(costs: DataFrame) -> DataFrame:
    """Adds ``motivo``: trimmed name of 1..120 characters, value not negative."""
    checks = [
        (_absent_or_outside("char_length(btrim(nome))", *COST_NAME_LENGTH), "nome"),
        ("not coalesce(valor >= 0, false)", "valor"),
    ]
    return costs.selectExpr("*", f"{_first_failing(checks)} as motivo")


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by more than one row, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("linhas")).where("linhas > 1")
