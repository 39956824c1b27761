"""Ad-insight rows to keyed facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadcurve.constants import (
    CHECKOUT_ACTIONS,
    DAILY_WINDOW_DAYS,
    HOURLY_WINDOW_DAYS,
    LANDING_VIEW,
    NO_NAME,
    PURCHASE_ACTIONS,
    VIDEO_VIEW,
)
from leadcurve.functions import actions as act
from leadcurve.functions.money import sum_money
from leadcurve.functions.numbers import count_or_zero, leading_int, money_or_zero, too_large
from leadcurve.functions.text import empty_to_null, or_else
from leadcurve.operators.periods import Period, in_date_period, trailing, within_dates

COUNTS = (
    "impressoes", "clicks", "v3s", "v2s", "thruplay", "p25", "lpv", "checkouts", "vendas",
)
AMOUNTS = ("gasto", "valor")


#: Measures of a record, as far as one look at it gives them; ``_acoes`` has those of the actions.
_MEASURES = {
    "gasto": money_or_zero("spend"),
    "impressoes": count_or_zero("impressions"),
    "clicks": count_or_zero("clicks"),
    "v3s": act.total_count("video_3_sec_watched_actions"),
    "v2s": act.total_count("video_continuous_2_sec_watched_actions"),
    "thruplay": act.total_count("video_thruplay_watched_actions"),
    "p25": act.total_count("video_p25_watched_actions"),
    "valor": act.largest_amount_of("action_values", PURCHASE_ACTIONS),
    "_acoes": act.fold("actions", {"v3s": VIDEO_VIEW, "lpv": LANDING_VIEW}, {"checkouts": CHECKOUT_ACTIONS, "vendas": PURCHASE_ACTIONS}),
}
_DAY = "try_cast(date_start as date)"
_TEXTS = {
    "data": _DAY,
    "hora_texto": "hourly_stats_aggregated_by_advertiser_time_zone",
    **{name: name for name in ("ad_id", "ad_name", "campaign_id", "campaign_name")},
}


def _flat(measured: DataFrame) -> DataFrame:
    """Typed rows of what ``_TEXTS`` and ``_MEASURES`` have read."""
    # plays listed among the actions add to the 3-second field
    measures = {name: name for name in _MEASURES if name != "_acoes"} | {"v3s": "v3s + _acoes.v3s"}
    measures |= {name: f"_acoes.{name}" for name in ("lpv", "checkouts", "vendas")}
    order = ("gasto", *COUNTS, "valor")
    return measured.selectExpr(*_TEXTS, *[f"coalesce({measures[name]}, 0) as {name}" for name in order])


def parse_insights(nested: DataFrame) -> DataFrame:
    """Nested records (all text) to flat typed rows, one per record.

    A field the export left out is null and counts as 0.
    """
    return _flat(nested.selectExpr(*[f"{value} as {name}" for name, value in (_TEXTS | _MEASURES).items()]))


def taken_insights(records: DataFrame, malformed: str, seen: Observation, campaign_text: str | None, period: Period) -> DataFrame:
    """As ``parse_insights``, the sound records of wanted campaigns and days.

    ``records`` has all lines of an export, ``malformed`` what is not null on
    those that are no JSON. ``seen`` learns how many there were (``lidas``),
    how many of them no JSON (``malformadas``) and how many refused by
    ``check_insights`` (``recusadas``). Nested fields do not pass the
    counting: each is read before it, and only of the rows that stay.
    """
    reason = F.expr(_reason(records.columns))
    stays = reason.isNull() & F.col(malformed).isNull() & F.expr(in_date_period(period, _DAY))
    if campaign_text:
        stays &= F.col("campaign_name").contains(campaign_text)
    stays = F.coalesce(stays, F.lit(False))
    read = [F.when(stays, F.expr(value)).alias(name) for name, value in (_TEXTS | _MEASURES).items()]
    counted = records.select(reason.alias("_motivo"), F.col(malformed).isNotNull().alias("_malformada"), stays.alias("_fica"), *read).observe(
        seen,
        F.expr("count(*) as lidas"),
        F.expr("count_if(_malformada) as malformadas"),
        F.expr("count_if(_motivo is not null and not _malformada) as recusadas"),
    )
    return _flat(counted.where("_fica"))


_COUNTED = ("actions", "video_3_sec_watched_actions", "video_continuous_2_sec_watched_actions", "video_thruplay_watched_actions", "video_p25_watched_actions")


def _reason(columns: Sequence[str]) -> str:
    """The first field with a number that its column cannot hold, null if all fit.

    Such a number has 16 digits or more in a row, or an exponent, so one look
    at all values of a record passes nearly every record by.
    """
    checks = {"spend": too_large("spend", amount=True)} | {c: too_large(c) for c in ("impressions", "clicks")}
    texts = [c for c in checks if c in columns]
    checks |= {c: act.holds_too_large(c) for c in _COUNTED} | {"action_values": act.holds_too_large("action_values", amounts=True)}
    texts += [f"{c}.value" for c in (*_COUNTED, "action_values") if c in columns]
    tests = " ".join(f"when {test} then '{name}'" for name, test in checks.items() if name in columns)
    # x: hexadecimal ones have an exponent too
    return f"case when concat_ws(' ', {', '.join(texts)}) rlike '[eExX]|[^ ]{{16}}' then case {tests} end end"


def check_insights(nested: DataFrame) -> DataFrame:
    """Adds ``motivo``: the first field with a number that its column cannot hold, null if all fit.

    Such a record is refused as a whole and the others stay, so that no
    count becomes 0 and no load ends because of it.
    """
    return nested.selectExpr("*", f"{_reason(nested.columns)} as motivo")


def _absent_from(key: str, ids: Sequence[str]) -> Column:
    """Key not among the ids; a null key stays."""
    return F.coalesce(~F.col(key).isin(list(ids)), F.lit(True))


def kept_rows(
    insights: DataFrame,
    campaign_text: str | None = None,
    excluded_campaigns: Sequence[str] = (),
    excluded_ads: Sequence[str] = (),
    period: Period | None = None,
) -> DataFrame:
    """Rows of wanted campaigns and days, without excluded campaigns and ads."""
    if period is not None:
        insights = within_dates(insights, period)
    if campaign_text:
        insights = insights.where(F.col("campaign_name").contains(campaign_text))
    if excluded_campaigns:
        insights = insights.where(_absent_from("campaign_id", excluded_campaigns))
    if excluded_ads:
        insights = insights.where(_absent_from("ad_id", excluded_ads))
    return insights


def combine_rows(insights: DataFrame) -> DataFrame:
    """Rows of the same day, ad and campaign as one, with their number as ``linhas``.

    What follows only adds up, so it gives the same on the combined rows.
    All buffers are numbers: this is a hash aggregation that combines before
    its shuffle. A load stores the outcome and reads its records only once.
    """
    return insights.groupBy("data", "ad_id", "ad_name", "campaign_id", "campaign_name").agg(
        F.expr("count(*) as linhas"), *_sums(COUNTS)
    )


def with_canonical_name(insights: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Adds ``anuncio`` (alias resolved) and ``absorvido`` (the alias changed it)."""
    named = insights.selectExpr("*", f"{or_else('ad_name', 'ad_id')} as _nome")
    if aliases is None:
        return named.withColumn("absorvido", F.lit(False)).withColumnRenamed("_nome", "anuncio")
    lookup = aliases.selectExpr("anuncio as _de", "canonico as _para")
    return named.join(lookup, F.expr("_nome = _de"), "left").selectExpr(
        "* except (_nome, _de, _para)",
        "coalesce(_para, _nome) as anuncio",
        "coalesce(_para != _nome, false) as absorvido",
    )


def _sums(counts: Sequence[str]) -> list[Column]:
    return [F.expr(f"{sum_money(a)} as {a}") for a in AMOUNTS] + [
        F.expr(f"sum({c}) as {c}") for c in counts
    ]


def daily_facts(named: DataFrame) -> DataFrame:
    """One row per ``(data, anuncio)``: 11 summed measures, an ad id, a campaign.

    Numbers are first summed per ad id and campaign too (hash aggregation
    that combines before its shuffle); texts are only compared on that.
    """
    per_text = named.groupBy("data", "anuncio", "ad_id", "campaign_name").agg(*_sums(COUNTS))
    return per_text.groupBy("data", "anuncio").agg(
        F.expr("min(coalesce(ad_id, '')) as ad_id"),
        F.expr("min(coalesce(campaign_name, '')) as campanha"),
        *_sums(COUNTS),
    )


def facts_of_combined(named: DataFrame) -> DataFrame:
    """The same as ``daily_facts`` for rows of ``combine_rows``, in one shuffle.

    These are about as few as the groups by ad id and campaign, so grouping
    by those first would shuffle nearly all rows once more. Texts make this a
    sorted aggregation; it also combines before its shuffle.
    """
    return named.groupBy("data", "anuncio").agg(
        F.expr("min(coalesce(ad_id, '')) as ad_id"),
        F.expr("min(coalesce(campaign_name, '')) as campanha"),
        *_sums(COUNTS),
    )


def daily_window(today: dt.date) -> Period:
    return trailing(today, DAILY_WINDOW_DAYS)


def hourly_window(today: dt.date) -> Period:
    return trailing(today, HOURLY_WINDOW_DAYS - 1)


def hourly_facts(insights: DataFrame) -> DataFrame:
    """One row per ``(data, hora, anuncio)``; rows without a valid hour drop out.

    The hour leads a text like ``13:00:00 - 13:59:59``. Ad names are taken
    as they are: no alias and no exclusion applies here.
    """
    timed = insights.selectExpr(
        "data",
        f"{leading_int('substring(hora_texto, 1, 2)')} as hora",
        f"{or_else('ad_name', repr(NO_NAME))} as anuncio",
        "gasto", "checkouts", "vendas", "valor",
    )
    return timed.where("hora between 0 and 23").groupBy("data", "hora", "anuncio").agg(
        *_sums(["checkouts", "vendas"])
    )


def ad_rollup(named: DataFrame, today: dt.date) -> DataFrame:
    """One row per ad: impressions, ``recente`` (delivered today or yesterday), campaign.

    The campaign is the latest one seen under the ad's own name, else the
    latest of an absorbed ad. Numbers are first combined per ad and campaign
    with fixed-width buffers (hash aggregation, little to shuffle); texts
    are only compared on that small result.
    """
    yesterday = today - dt.timedelta(days=1)
    combined = named.groupBy(
        "anuncio", "absorvido", "ad_id", F.expr(f"{empty_to_null('campaign_name')} as campanha")
    ).agg(
        F.expr("sum(impressoes) as impressoes"),
        F.expr(f"bool_or(impressoes > 0 and data >= date'{yesterday}') as recente"),
        F.expr("max(data) as _ate"),
    )
    latest = "max_by(campanha, struct(_ate, campanha)) filter (where campanha is not null"
    return combined.groupBy("anuncio").agg(
        F.expr("min(ad_id) as ad_id"),
        F.expr(f"coalesce({latest} and not absorvido), {latest}), '') as campanha"),
        F.expr("sum(impressoes) as impressoes"),
        F.expr("coalesce(bool_or(recente), false) as recente"),
    )
