"""The five dashboard functions over one set of tables.

Parameters left at None do not filter, and add nothing to the plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from leadcurve.operators import creatives, funnel, reports
from leadcurve.operators.periods import between

Day = str | dt.date | None


@dataclass(frozen=True)
class Dashboard:
    """Tables as DataFrames, under the names the functions use."""

    eventos: DataFrame
    paginas: DataFrame
    criativos: DataFrame
    consolidar: DataFrame
    criativos_diario: DataFrame
    criativos_hora: DataFrame

    def fn_funil(
        self,
        p_de: Day = None,
        p_ate: Day = None,
        p_variantes: Sequence[str] | None = None,
        p_funil: str | None = None,
        p_fonte: str | None = None,
    ) -> DataFrame:
        """One row: visitantes, compraram, fim, and the array etapas of (n, sessoes)."""
        return funnel.funnel(
            self.eventos, self.paginas, between(p_de, p_ate), p_variantes, p_funil, p_fonte
        )

    def fn_variantes(
        self, p_de: Day = None, p_ate: Day = None, p_funil: str | None = None, p_fonte: str | None = None
    ) -> DataFrame:
        """variante, sessoes, ini, fim; most sessions first."""
        return funnel.variants_available(
            self.eventos, self.paginas, between(p_de, p_ate), p_funil, p_fonte
        )

    def fn_criativos(self, p_de: Day = None, p_ate: Day = None) -> DataFrame:
        """Labels and summed measures of every creative that is not absorbed by another."""
        return creatives.creative_metrics(
            self.criativos, self.criativos_diario, self.consolidar, between(p_de, p_ate)
        )

    def fn_diario(self, p_de: Day = None, p_ate: Day = None) -> DataFrame:
        """data, gasto, faturamento, vendas, checkouts, by day."""
        return reports.daily_series(self.criativos_diario, between(p_de, p_ate))

    def fn_horario(self, p_de: Day = None, p_ate: Day = None) -> DataFrame:
        """hora, gasto, faturamento, vendas, checkouts: 24 rows."""
        return reports.hourly_series(self.criativos_hora, between(p_de, p_ate))
