"""Creatives: period metrics, status, and the per-creative report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.constants import DIAMOND_MAX_CPC, DIAMOND_MIN_CTR, DIAMOND_MIN_SPEND, TAGS
from leadcurve.functions.money import (
    MONEY,
    money_or_nothing,
    net_income,
    revenue_or_list_price,
    sum_money,
)
from leadcurve.functions.numbers import half_up, ratio, rounded_ratio
from leadcurve.functions.text import utc_literal
from leadcurve.operators.periods import EVERYTHING, Period, within_dates

LABELS = ("anuncio", "campanha", "status", *TAGS)
_SUMS = ("impressoes", "clicks", "thruplay", "p25", "lpv", "checkouts", "vendas")

# 3-second plays, or 2-second plays where there are none
THREE_SECOND_PLAYS = "case when v3s > 0 then v3s else v2s end"


def not_absorbed(creatives: DataFrame, aliases: DataFrame) -> DataFrame:
    """Creatives that are not merged into another one."""
    return creatives.join(aliases.select("anuncio"), "anuncio", "left_anti")


def _totals(daily: DataFrame, *more: str) -> DataFrame:
    return daily.groupBy("anuncio").agg(
        F.expr(f"{sum_money('gasto')} as gasto"),
        F.expr(f"{sum_money('valor')} as valor"),
        *[F.expr(f"sum({c}) as {c}") for c in _SUMS],
        *[F.expr(m) for m in more],
    )


def creative_metrics(
    creatives: DataFrame, daily: DataFrame, aliases: DataFrame, period: Period = EVERYTHING
) -> DataFrame:
    """Labels and summed measures of each creative in the period.

    Creatives without a row in the period stay, with zeros. Manual
    adjustments are always added. The facts are reduced to one row per ad
    before they are joined.
    """
    totals = _totals(within_dates(daily, period), f"sum({THREE_SECOND_PLAYS}) as v3s")
    counts = ("impressoes", "clicks", "v3s", "thruplay", "p25", "lpv", "checkouts")
    return (
        not_absorbed(creatives, aliases)
        .join(totals, "anuncio", "left")
        .selectExpr(
            *LABELS,
            f"{money_or_nothing('gasto')} as gasto",
            *[f"coalesce({c}, 0L) as {c}" for c in counts],
            "coalesce(vendas, 0L) + coalesce(vendas_ajuste, 0) as vendas",
            f"cast(coalesce(valor, 0) + coalesce(valor_ajuste, 0) as {MONEY}) as valor",
        )
    )


def sheet_metrics(
    creatives: DataFrame,
    sheet_daily: DataFrame,
    period: Period = EVERYTHING,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Period metrics by the older generation's rules.

    Daily rows may repeat an ad and day. No alias is resolved; the 3-second
    and list-price fallbacks apply to the period totals; a creative without
    rows is all zeros and its manual adjustment is ignored. ``keep`` names
    more creative columns to pass on.
    """
    rows = within_dates(sheet_daily, period).where("anuncio != ''")
    totals = _totals(rows, "sum(v3s) as v3s", "sum(v2s) as v2s", "true as _tem")
    revenue = f"{revenue_or_list_price('valor', 'vendas')} + coalesce(valor_ajuste, 0)"
    counts = ("impressoes", "clicks", "thruplay", "p25", "lpv", "checkouts")
    return (
        creatives.where("anuncio != ''")
        .join(totals, "anuncio", "left")
        .selectExpr(
            *LABELS,
            *keep,
            f"{money_or_nothing('gasto')} as gasto",
            *[f"coalesce({c}, 0L) as {c}" for c in counts],
            f"coalesce({THREE_SECOND_PLAYS}, 0L) as v3s",
            "if(_tem, vendas + coalesce(vendas_ajuste, 0), 0L) as vendas",
            f"cast(if(_tem, {revenue}, 0) as {MONEY}) as valor",
        )
    )


def creative_report(metrics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ratios, net income and the diamond flag for each creative's period metrics.

    A ratio is null when its denominator is 0. ``valor`` becomes
    ``faturamento``. The diamond asks for enough spend, a high click rate and
    a low cost per click at once, with clicks rebuilt from the rounded rate.
    """
    clicks = "(impressoes * ctr_pct / 100D)"
    cost_per_click = ratio("gasto", clicks)
    return (
        metrics.selectExpr(
            *LABELS,
            *keep,
            "gasto",
            "impressoes",
            f"{rounded_ratio('clicks', 'impressoes', 10000, 0)} / 100D as ctr_pct",
            f"case when v3s != 0 then {rounded_ratio('v3s', 'impressoes', 100, 1)} end as hook_rate_pct",
            f"{rounded_ratio('thruplay', 'v3s', 100, 1)} as hold_rate_pct",
            f"{rounded_ratio('p25', 'impressoes', 100, 1)} as views25_pct",
            "lpv",
            f"{rounded_ratio('gasto', 'lpv', 1, 2)} as custo_lpv",
            "checkouts",
            f"{rounded_ratio('gasto', 'checkouts', 1, 2)} as custo_checkout",
            "vendas",
            f"{rounded_ratio('gasto', 'vendas', 1, 2)} as custo_venda",
            "valor as faturamento",
            f"{rounded_ratio('valor', 'gasto', 100, 0)} / 100D as roas",
            f"{net_income('valor', 'vendas')} as liquido",
        )
        .selectExpr(
            "*",
            f"{rounded_ratio('(liquido - gasto)', 'gasto', 100, 1)} as roi_pct",
            f"coalesce(gasto >= {DIAMOND_MIN_SPEND} and ctr_pct >= {DIAMOND_MIN_CTR} "
            f"and {cost_per_click} <= {DIAMOND_MAX_CPC}D, false) as diamante",
        )
    )


# --- status and upkeep ------------------------------------------------------
def _plain(status: str) -> str:
    return f"lower(btrim(coalesce({status}, '')))"


def _next_status(stored: str, recent: str) -> str:
    """The status of a delivered ad; ``stored`` is the present one, plain."""
    automatic = f"coalesce({stored}, '') in ('', 'ativo', 'rodando', 'testado')"
    return f"case when not {automatic} then {stored} when {recent} then 'ativo' else 'testado' end"


def rollup_status(rollup: DataFrame, creatives: DataFrame) -> DataFrame:
    """Delivered ads with the status each should get.

    The status is automatic unless a hand-written one is stored; that one is
    kept in lower case.
    """
    stored = creatives.selectExpr("anuncio", f"{_plain('status')} as _status")
    return (
        rollup.where("impressoes > 0")
        .join(stored, "anuncio", "left")
        .selectExpr(
            "anuncio",
            "ad_id",
            "campanha",
            "impressoes",
            "recente",
            f"{_next_status('_status', 'recente')} as status",
        )
    )


def _load_time(creatives: DataFrame, when: dt.datetime) -> str:
    """The load time in the type the table keeps it in (a sheet keeps text)."""
    return f"cast({utc_literal(when)} as {dict(creatives.dtypes)['atualizado']}) as _atualizado"


def upsert_creatives(creatives: DataFrame, rollup: DataFrame, when: dt.datetime) -> DataFrame:
    """New version of the creative table after a load.

    Delivered ads get a fresh id, campaign, status and time; their tags and
    manual adjustments, and all other creatives, stay as they were.
    """
    new = rollup.where("impressoes > 0").selectExpr(
        "anuncio",
        "coalesce(ad_id, '') as _ad_id",
        "campanha as _campanha",
        "recente as _recente",
        _load_time(creatives, when),
    )
    # one full outer join: the stored status is there to decide the new one
    decided = _next_status(_plain("status"), "_recente")
    fresh = {c: f"if(_atualizado is not null, _{c}, {c})" for c in ("ad_id", "campanha", "atualizado")}
    fresh["status"] = f"if(_atualizado is not null, {decided}, status)"
    fresh |= {c: f"coalesce({c}, 0)" for c in ("vendas_ajuste", "valor_ajuste")}
    return creatives.join(new, "anuncio", "full_outer").selectExpr(
        *[f"cast({fresh.get(c, c)} as {kind}) as {c}" for c, kind in creatives.dtypes]
    )


def insert_new_creatives(creatives: DataFrame, rollup: DataFrame, when: dt.datetime) -> DataFrame:
    """New version of the creative table by the older generation's rule.

    Delivered ads that are not listed are added as ``rodando``; listed ones
    keep all their labels and only get the time of the load.
    """
    new = rollup.where("impressoes > 0").selectExpr(
        "anuncio", "ad_id as _ad_id", "campanha as _campanha", _load_time(creatives, when)
    )
    listed = creatives.withColumn("_listado", F.lit(True))
    added = {"ad_id": "_ad_id", "campanha": "_campanha", "status": "'rodando'"}
    chosen = {c: f"if(_listado, {c}, {value})" for c, value in added.items()}
    chosen |= {c: f"coalesce({c}, 0)" for c in ("vendas_ajuste", "valor_ajuste")}
    chosen["atualizado"] = "coalesce(_atualizado, atualizado)"
    return listed.join(new, "anuncio", "full_outer").selectExpr(
        *[f"cast({chosen.get(c, c)} as {kind}) as {c}" for c, kind in creatives.dtypes]
    )


SHEET_FIGURES = (
    "gasto", "impressoes", "ctr_pct", "hook_rate_pct", "hold_rate_pct", "views25_pct", "lpv", "custo_lpv",
    "checkouts", "custo_checkout", "vendas", "custo_venda", "faturamento", "roas", "roi_pct",
)


def refresh_sheet(
    sheet: DataFrame, sheet_daily: DataFrame, rollup: DataFrame, when: dt.datetime
) -> DataFrame:
    """The older generation's wide creative sheet after a load.

    Ads that are not listed are added. Delivered ads get the figures of the
    whole history; a hook rate stays as it was where there are no plays.
    Other rows, and all labels and adjustments, stay.
    """
    stored = {name: f"_{name}" for name in SHEET_FIGURES}
    listed = insert_new_creatives(sheet, rollup, when).withColumnsRenamed(stored)
    keep = ("ad_id", "vendas_ajuste", "valor_ajuste", "atualizado", *stored.values())
    report = creative_report(sheet_metrics(listed, sheet_daily, keep=keep), keep)
    special = {"lpv": "nullif(lpv, 0L)", "hook_rate_pct": "coalesce(hook_rate_pct, _hook_rate_pct)"}
    figures = {c: f"if(impressoes > 0, {special.get(c, c)}, {stored[c]})" for c in SHEET_FIGURES}
    return report.selectExpr(
        *[f"cast({figures.get(c, c)} as {kind}) as {c}" for c, kind in sheet.dtypes]
    )


def rename_running(creatives: DataFrame) -> DataFrame:
    """Status ``rodando``, in any spelling of case and blanks, becomes ``ativo``."""
    running = F.expr(f"{_plain('status')} = 'rodando'")
    return creatives.withColumn("status", F.when(running, "ativo").otherwise(F.col("status")))


def with_medals(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """First medal rule, in stored order, that a creative's sales and return meet.

    ``rules`` holds one row with the rule array; it is read as a scalar
    subquery, so creatives are neither joined nor multiplied.
    """
    met = "r -> vendas >= r.vendas and gasto > 0 and valor >= r.roas * gasto"
    return (
        metrics.withColumn("_regras", rules.scalar())
        .selectExpr("*", f"get(filter(_regras, {met}), 0) as _medalha")
        .selectExpr(
            "anuncio",
            "gasto",
            "vendas",
            "valor",
            f"{half_up(ratio('valor', 'gasto'), 2)} as roas",
            "_medalha.nome as medalha",
            "_medalha.selo as selo",
        )
    )
