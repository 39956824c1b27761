"""Reports over facts and over the per-creative report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.constants import GROUP_TAGS, NO_TAG
from leadcurve.functions.money import (
    money_or_nothing,
    net_income,
    revenue_or_list_price,
    sum_money,
)
from leadcurve.functions.numbers import half_up, ratio
from leadcurve.functions.text import or_else
from leadcurve.operators.events import check_costs, valid
from leadcurve.operators.periods import EVERYTHING, Period, within_dates


# --- series -----------------------------------------------------------------
def _series(facts: DataFrame, key: str) -> DataFrame:
    revenue = sum_money(revenue_or_list_price("valor", "vendas"))
    return facts.groupBy(key).agg(
        F.expr(f"{sum_money('gasto')} as gasto"),
        F.expr(f"{revenue} as faturamento"),
        F.expr("sum(vendas) as vendas"),
        F.expr("sum(checkouts) as checkouts"),
    )


def daily_series(daily: DataFrame, period: Period = EVERYTHING) -> DataFrame:
    """Spend, revenue, sales and checkouts of each day that has rows."""
    return _series(within_dates(daily, period), "data").orderBy("data")


def hourly_series(hourly: DataFrame, period: Period = EVERYTHING) -> DataFrame:
    """The same by hour of day: always 24 rows, summed over the days."""
    measures = _series(within_dates(hourly, period), "hora")
    hours = hourly.sparkSession.range(24).selectExpr("cast(id as int) as hora")
    # at most 24 rows on either side
    return (
        hours.join(F.broadcast(measures), "hora", "left")
        .selectExpr(
            "hora",
            f"{money_or_nothing('gasto')} as gasto",
            f"{money_or_nothing('faturamento')} as faturamento",
            "coalesce(vendas, 0L) as vendas",
            "coalesce(checkouts, 0L) as checkouts",
        )
        .orderBy("hora")
    )


def costs_in_period(costs: DataFrame, period: Period = EVERYTHING) -> DataFrame:
    """Number and sum of the valid costs whose accrual date lies in the period."""
    kept = within_dates(valid(check_costs(costs)), period)
    return kept.agg(
        F.expr("count(*) as lancamentos"), F.expr(f"{money_or_nothing(sum_money('valor'))} as total")
    )


# --- groups -----------------------------------------------------------------
def by_tag(report: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Report rows repeated once per tag, as ``etiqueta, grupo``; no tag has its own group."""
    pairs = [f"named_struct('etiqueta', '{t}', 'grupo', {or_else(t, repr(NO_TAG))})" for t in tags]
    measures = ("gasto", "impressoes", "ctr_pct", "checkouts", "vendas", "faturamento")
    return report.selectExpr(f"inline(array({', '.join(pairs)}))", *measures)


_ROI = ratio(f"({net_income('faturamento', 'vendas')} - gasto)", "gasto", 100)


def tag_report(report: DataFrame, tags: Sequence[str] = GROUP_TAGS) -> DataFrame:
    """Totals and costs of each tag value; net income comes from the group totals.

    Ordered by cost per sale, groups without one last.
    """
    groups = by_tag(report, tags).groupBy("etiqueta", "grupo").agg(
        F.expr("count(*) as n"),
        F.expr(f"{sum_money('gasto')} as gasto"),
        F.expr("sum(checkouts) as checkouts"),
        F.expr("sum(vendas) as vendas"),
        F.expr(f"{sum_money('faturamento')} as faturamento"),
    )
    return groups.selectExpr(
        "*",
        f"{ratio('gasto', 'checkouts')} as custo_checkout",
        f"{ratio('gasto', 'vendas')} as custo_venda",
        f"{ratio('faturamento', 'gasto')} as roas",
        f"{_ROI} as roi_pct",
    ).orderBy("etiqueta", F.expr("nullif(custo_venda, 0D)").asc_nulls_last(), "grupo")


def tag_metrics(report: DataFrame, tags: Sequence[str] = GROUP_TAGS) -> DataFrame:
    """Every metric of every tag value, unrounded: ``etiqueta, grupo, metrica, bruto``.

    Clicks are rebuilt from the rounded click rate, exactly, as hundredths.
    """
    hundredths = "impressoes * cast(coalesce(ctr_pct, 0D) as decimal(12,2))"
    groups = by_tag(report, tags).groupBy("etiqueta", "grupo").agg(
        F.expr(f"{sum_money('gasto')} as gasto"),
        F.expr("sum(vendas) as vendas"),
        F.expr("sum(impressoes) as impressoes"),
        F.expr(f"{sum_money('faturamento')} as faturamento"),
        F.expr(f"cast({sum_money(hundredths)} as double) / 100D as cliques"),
    )
    values = {
        "cpa": ratio("gasto", "vendas"),
        "roas": ratio("faturamento", "gasto"),
        "roi": _ROI,
        "faturamento": "cast(faturamento as double)",
        "ctr": ratio("cliques", "impressoes", 100),
        "cpc": ratio("gasto", "cliques"),
        "gasto": "cast(gasto as double)",
    }
    cells = [f"named_struct('metrica', '{k}', 'bruto', {v})" for k, v in values.items()]
    return groups.selectExpr("etiqueta", "grupo", f"inline(array({', '.join(cells)}))")


def tag_metric_matrix(report: DataFrame, tags: Sequence[str] = GROUP_TAGS) -> DataFrame:
    """Metrics above 0, rounded to 2 decimals."""
    kept = tag_metrics(report, tags).where("bruto > 0")
    return kept.selectExpr("etiqueta", "grupo", "metrica", f"{half_up('bruto', 2)} as valor")


def tag_negative_roi(report: DataFrame, tags: Sequence[str] = GROUP_TAGS) -> DataFrame:
    """Groups that do not earn back their spend."""
    losing = tag_metrics(report, tags).where("metrica = 'roi' and bruto <= 0")
    return losing.selectExpr("etiqueta", "grupo", "bruto as roi_pct")


def kpi_totals(report: DataFrame) -> DataFrame:
    """Totals over all creatives; return figures are 0 without spend."""
    totals = report.agg(
        F.expr("count_if(btrim(anuncio) != '') as criativos"),
        F.expr(f"{money_or_nothing(sum_money('gasto'))} as gasto"),
        F.expr("coalesce(sum(checkouts), 0L) as checkouts"),
        F.expr("coalesce(sum(vendas), 0L) as vendas"),
        F.expr(f"{money_or_nothing(sum_money('faturamento'))} as faturamento"),
    )
    return totals.selectExpr(
        "*",
        f"{net_income('faturamento', 'vendas')} as liquido",
        f"coalesce({ratio('faturamento', 'gasto')}, 0D) as roas",
        f"coalesce({_ROI}, 0D) as roi_pct",
    )


# chart -> order key of its values
TOP_CHARTS = {
    "custo_venda": "custo_venda",
    "custo_checkout": "custo_checkout",
    "hook_rate_pct": "-hook_rate_pct",
    "hold_rate_pct": "-hold_rate_pct",
}


def top_creatives(report: DataFrame, k: int = 8) -> DataFrame:
    """The k best creatives of each chart, among values above 0.

    One pass for all charts. Spark keeps only the k best of each chart in
    every task before the shuffle (window group limit), so the ranking task
    receives k rows per task.
    """
    cells = [
        f"named_struct('grafico', '{name}', 'valor', {name}, '_ordem', {order})"
        for name, order in TOP_CHARTS.items()
    ]
    rank = F.row_number().over(Window.partitionBy("grafico").orderBy("_ordem", "anuncio"))
    return (
        report.selectExpr("anuncio", "diamante", f"inline(array({', '.join(cells)}))")
        .where("valor > 0")
        .withColumn("posicao", rank)
        .where(F.col("posicao") <= k)
        .select("grafico", "posicao", "anuncio", "valor", "diamante")
        .orderBy("grafico", "posicao")
    )
