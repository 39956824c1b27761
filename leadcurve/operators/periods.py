"""Reporting periods and the filters made from them.

``today`` is always a parameter: the same call gives the same answer on any day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

from leadcurve.constants import LOCAL_ZONE, PRESET_LABELS
from leadcurve.sources.local import local_table

ONE_DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """Inclusive date range; a missing bound is open."""

    start: dt.date | None = None
    end: dt.date | None = None
    label: str = PRESET_LABELS["todos"]
    preset: str = "todos"


EVERYTHING = Period()


def between(start: str | dt.date | None, end: str | dt.date | None) -> Period:
    """Custom period from dates or ISO text; empty means open."""
    first, last = _as_date(start), _as_date(end)
    shown = [d.strftime("%d/%m/%Y") if d else "" for d in (first, last)]
    return Period(first, last, shown[0] if first == last else " – ".join(shown), "custom")


def _as_date(value: str | dt.date | None) -> dt.date | None:
    if not value:
        return None
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def presets(today: dt.date) -> dict[str, Period]:
    """The named periods as seen on ``today``; weeks start on Monday."""
    monday = today - today.weekday() * ONE_DAY
    month = today.replace(day=1)
    last_month_end = month - ONE_DAY
    ranges = {
        "hoje": (today, today),
        "ontem": (today - ONE_DAY, today - ONE_DAY),
        **{f"{n}d": (today - (n - 1) * ONE_DAY, today) for n in (7, 14, 28, 30)},
        "semana": (monday, today),
        "semana_passada": (monday - 7 * ONE_DAY, monday - ONE_DAY),
        "mes": (month, today),
        "mes_passado": (last_month_end.replace(day=1), last_month_end),
        "todos": (None, None),
    }
    return {name: Period(a, b, PRESET_LABELS[name], name) for name, (a, b) in ranges.items()}


def resolve(
    today: dt.date,
    preset: str | None = None,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
) -> Period:
    """Period asked for by a preset name and/or explicit bounds.

    Bounds without a preset mean ``custom``; a custom period with only a
    start is that one day; an unknown preset is open.
    """
    name = preset or ("custom" if start or end else "todos")
    if name == "custom":
        return between(start, end or start)
    return presets(today).get(name, EVERYTHING)


def period_table(spark: SparkSession, periods: Mapping[str, Period]) -> DataFrame:
    """One row per period: ``preset, de, ate, rotulo``."""
    rows = [(name, p.start, p.end, p.label) for name, p in periods.items()]
    return local_table(spark, "preset string, de date, ate date, rotulo string", rows)


def hull(periods: Mapping[str, Period]) -> Period:
    """The shortest period that holds all of them; open where one of them is."""
    starts, ends = [p.start for p in periods.values()], [p.end for p in periods.values()]
    return Period(min(starts, default=None) if None not in starts else None, max(ends, default=None) if None not in ends else None)


def trailing(today: dt.date, days_back: int) -> Period:
    """``today`` and the ``days_back`` days before it."""
    return Period(today - days_back * ONE_DAY, today, f"{days_back}d", "custom")


def utc_midnight(day: dt.date) -> dt.datetime:
    """Zone-less UTC time at which a local day starts."""
    local = dt.datetime.combine(day, dt.time(), ZoneInfo(LOCAL_ZONE))
    return local.astimezone(dt.timezone.utc).replace(tzinfo=None)


def local_date(ts: str) -> str:
    """Local calendar date of a zone-less UTC timestamp."""
    return f"to_date(convert_timezone('UTC', '{LOCAL_ZONE}', {ts}))"


def in_local_period(period: Period, ts: str = "ts") -> str:
    """Condition "local date of ``ts`` lies in the period" (``true`` when open).

    The bounds are moved to UTC instead of the column to local time, so the
    condition is a plain range on the stored column: Parquet statistics and
    pushdown serve it, and no row is converted.
    """
    tests = []
    if period.start:
        tests.append(f"{ts} >= timestamp_ntz'{utc_midnight(period.start)}'")
    if period.end:
        tests.append(f"{ts} < timestamp_ntz'{utc_midnight(period.end + ONE_DAY)}'")
    return " and ".join(tests) or "true"


def in_date_period(period: Period, day: str = "data") -> str:
    """Condition on a date column that needs no zone shift (``true`` when open)."""
    tests = []
    if period.start:
        tests.append(f"{day} >= date'{period.start}'")
    if period.end:
        tests.append(f"{day} <= date'{period.end}'")
    return " and ".join(tests) or "true"


def require_utc(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The same rows, if their time is a zone-less UTC timestamp.

    A timestamp with time zone would be read in the session's zone;
    ``functions.text.utc_of_instant`` turns it into UTC.
    """
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        raise TypeError(f"{ts} must be timestamp_ntz holding UTC time")
    return df


def within_local_period(df: DataFrame, period: Period, ts: str = "ts", day: str = "dia") -> DataFrame:
    """Rows whose local date lies in the period.

    A table written by local day (column ``dia``) is pruned by directory too.
    """
    require_utc(df, ts)
    if day in df.columns:
        df = df.where(in_date_period(period, day))
    return df.where(in_local_period(period, ts))


def within_dates(df: DataFrame, period: Period, day: str = "data", month: str = "mes") -> DataFrame:
    """Rows whose date lies in the period, pruned by month directory where there are such."""
    if month in df.columns:
        months = Period(*(d and d.replace(day=1) for d in (period.start, period.end)))
        df = df.where(in_date_period(months, month))
    return df.where(in_date_period(period, day))
