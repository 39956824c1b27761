"""Sessions, step curve, retention and alerts.

A session counts by the furthest screen it reached, so the curve never
rises. The roll-up is one shuffle on the session; what follows is a
histogram of at most 35 rows per period. Max and boolean-or combine before
the shuffle, so a session holding a large part of all pings sends one row
per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.constants import (
    BODY_FIRST,
    BODY_LAST,
    BUY_STAGE,
    DEFAULT_FUNNEL,
    DEFAULT_SOURCE,
    DROP_ALERT,
    PITCH_FIRST,
    SCREENS,
)
from leadcurve.functions.numbers import half_up, leading_int
from leadcurve.operators.periods import (
    EVERYTHING,
    Period,
    hull,
    in_date_period,
    in_local_period,
    local_date,
    period_table,
    within_dates,
    within_local_period,
)


# --- which pings count ------------------------------------------------------
def stage_pings(events: DataFrame) -> DataFrame:
    """Pings of type ``etapa`` that carry a stage."""
    return events.where("tipo = 'etapa' and etapa is not null")


def of_variants(events: DataFrame, variants: Sequence[str] | None) -> DataFrame:
    """Pings of the listed variants; None keeps all, a list drops null variants."""
    return events if variants is None else events.where(F.col("variante").isin(list(variants)))


def of_page_group(
    events: DataFrame, pages: DataFrame | None, funnel: str | None = None, source: str | None = None
) -> DataFrame:
    """Pings whose page belongs to a funnel and/or traffic source.

    An empty or unknown page counts as the default funnel and source. The
    page table is small; its size, known to Catalyst, decides on a broadcast.
    """
    if funnel is None and source is None:
        return events
    lookup = pages.selectExpr("codigo as _codigo", "funil as _funil", "fonte as _fonte")
    joined = events.join(lookup, F.expr("pagina = _codigo"), "left")
    for name, default, wanted in (
        ("_funil", DEFAULT_FUNNEL, funnel),
        ("_fonte", DEFAULT_SOURCE, source),
    ):
        if wanted is not None:
            joined = joined.where(F.coalesce(name, F.lit(default)) == wanted)
    return joined.select(*events.columns)


# --- sessions ---------------------------------------------------------------
SCREEN = f"cast(case when etapa between 1 and {SCREENS} then etapa else 0 end as int)"
BOUGHT = f"etapa = {BUY_STAGE}"


def session_rollup(pings: DataFrame, *by: str) -> DataFrame:
    """One row per session: furthest screen ``maxi`` (0 if none) and ``comprou``."""
    return pings.groupBy(*by, "sessao").agg(
        F.expr(f"max({SCREEN}) as maxi"),
        F.expr(f"coalesce(bool_or({BOUGHT}), false) as comprou"),
    )


def sheet_sessions(raw: DataFrame, period: Period = EVERYTHING) -> DataFrame:
    """Sessions of the older generation, from raw text rows.

    Any ping type counts and the stage is whatever number leads its text.
    ``ts`` must already be a timestamp (null when unreadable); such rows
    drop out only when the period has a bound.
    """
    pings = within_local_period(raw, period).where("sessao != ''")
    return session_rollup(pings.selectExpr("sessao", f"{leading_int('etapa')} as etapa"))


def sessions_by_period(pings: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    """``preset, sessao, maxi, comprou`` for many periods in one pass.

    Each period is a pair of conditional aggregates, so the pings are
    shuffled once and never multiplied by the number of periods. A session
    without a ping in a period has null there. If all periods are closed,
    only the pings of their hull are read.
    """
    pings = within_local_period(pings, hull(periods))
    measures, rows = [], []
    for i, (name, period) in enumerate(periods.items()):
        inside = f"filter (where {in_local_period(period)})"
        measures += [
            F.expr(f"max({SCREEN}) {inside} as _m{i}"),
            F.expr(f"bool_or({BOUGHT}) {inside} as _b{i}"),
        ]
        rows.append(f"named_struct('preset', '{name}', 'maxi', _m{i}, 'comprou', _b{i})")
    wide = pings.groupBy("sessao").agg(*measures)
    return wide.selectExpr("sessao", f"inline(array({', '.join(rows)}))").where("maxi is not null")


def day_sessions_by_period(days: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    """As ``sessions_by_period``, out of session-days (``dia, sessao, maxi, comprou``) in place of pings.

    A session that crosses days has a row for each of them, with the furthest
    screen of that day alone, so any period has what its own pings gave.
    """
    days = within_dates(days, hull(periods), "dia")
    measures, rows = [], []
    for i, (name, period) in enumerate(periods.items()):
        inside = f"filter (where {in_date_period(period, 'dia')})"
        measures += [F.expr(f"max(maxi) {inside} as _m{i}"), F.expr(f"bool_or(comprou) {inside} as _b{i}")]
        rows.append(f"named_struct('preset', '{name}', 'maxi', _m{i}, 'comprou', _b{i})")
    wide = days.groupBy("sessao").agg(*measures)
    return wide.selectExpr("sessao", f"inline(array({', '.join(rows)}))").where("maxi is not null")


# --- totals and curve -------------------------------------------------------
def funnel_totals(sessions: DataFrame, *by: str) -> DataFrame:
    """Visitors, buyers, finished, and ``etapas``: an array of ``{n, sessoes}``.

    Sessions are counted per furthest screen; a step's count is the sum over
    that screen and all later ones.
    """
    histogram = sessions.groupBy(*by, "maxi").agg(
        F.expr("count(*) as _n"), F.expr("count_if(comprou) as _compraram")
    )
    gathered = histogram.groupBy(*by).agg(
        F.expr("coalesce(sum(_compraram), 0L) as compraram"),
        # at most 35 entries: one per furthest screen
        F.expr("collect_list(named_struct('maxi', maxi, 'n', _n)) as _histograma"),
    )

    def reached(step: str) -> str:
        later = f"filter(_histograma, h -> h.maxi >= {step})"
        return f"aggregate({later}, 0L, (acc, h) -> acc + h.n)"

    return gathered.selectExpr(
        *by,
        f"{reached('1')} as visitantes",
        "compraram",
        f"{reached(str(SCREENS))} as fim",
        f"transform(sequence(1, {SCREENS}), s -> named_struct('n', s, 'sessoes', {reached('s')})) as etapas",
    )


def funnel(
    events: DataFrame,
    pages: DataFrame | None = None,
    period: Period = EVERYTHING,
    variants: Sequence[str] | None = None,
    funnel: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """The funnel of a period, optionally of some variants, one funnel, one source."""
    pings = of_variants(within_local_period(stage_pings(events), period), variants)
    return funnel_totals(session_rollup(of_page_group(pings, pages, funnel, source)))


def as_json(totals: DataFrame) -> DataFrame:
    """The totals as one JSON text."""
    return totals.select(F.to_json(F.struct("visitantes", "compraram", "fim", "etapas")).alias("funil"))


def _permille(part: str, whole: str) -> str:
    """Percentage with one decimal."""
    return f"({half_up(f'cast({part} as double) / cast({whole} as double) * 1000D')} / 10D)"


def percentages(totals: DataFrame) -> DataFrame:
    """Adds finish and buy percentages (0 without visitors)."""

    def share(part: str) -> str:
        return f"case when visitantes != 0 then {_permille(part, 'visitantes')} else 0D end"

    return totals.selectExpr("*", f"{share('fim')} as pct_fim", f"{share('compraram')} as pct_compra")


def steps(totals: DataFrame, *by: str) -> DataFrame:
    """The curve as rows ``n, sessoes``."""
    return totals.selectExpr(*by, "inline(etapas)").orderBy(*by, "n")


def retention(totals: DataFrame, *by: str, labels: Sequence[str] = ()) -> DataFrame:
    """Retention per screen, drop against the previous one, and flags.

    Retentions are rounded before they are subtracted. Screens without a
    label are called ``Tela n``. The window runs over 34 rows per group.
    """
    base = "greatest(etapas[0].sessoes, 1L)"
    curve = totals.selectExpr(*by, f"{base} as _base", "inline(etapas)").selectExpr(
        *by, "n", "sessoes as acessos", f"{_permille('sessoes', '_base')} as ret"
    )
    previous = F.lag("ret").over(Window.partitionBy(*by).orderBy("n"))
    named = curve.withColumn("_anterior", previous)
    label = F.expr("concat('Tela ', n)")
    if labels:
        texts = F.array(*[F.lit(text) for text in labels[:SCREENS]])
        label = F.coalesce(F.get(texts, F.expr("n - 1")), label)
    return (
        named.withColumn("nome", label)
        .selectExpr(*by, "n", "nome", "acessos", "ret", f"coalesce({half_up('_anterior - ret', 1)}, 0D) as queda")
        .selectExpr(
            "*",
            f"n between {BODY_FIRST} and {BODY_LAST} and queda > {DROP_ALERT} as alerta",
            f"n >= {PITCH_FIRST} as pitch",
        )
    )


def alerts(curve: DataFrame) -> DataFrame:
    """Body screens whose drop is above the alert threshold."""
    return curve.where("alerta").select("n", "queda")


def biggest_drop(curve: DataFrame) -> DataFrame:
    """Screen of the largest body drop (first on ties) and all alert screens.

    Without any drop above 0 the screen is 0 and the drop 0.0.
    """
    dropping = f"filter (where n between {BODY_FIRST} and {BODY_LAST} and queda > 0)"
    return curve.agg(
        F.expr(f"coalesce(max_by(n, struct(queda, -n)) {dropping}, 0) as tela"),
        F.expr(f"coalesce(max(queda) {dropping}, 0D) as queda"),
        F.expr("array_sort(collect_list(n) filter (where alerta)) as alertas"),
    )


# --- variants ---------------------------------------------------------------
def variants_available(
    events: DataFrame,
    pages: DataFrame | None = None,
    period: Period = EVERYTHING,
    funnel: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Variants seen, with distinct sessions and first and last local day.

    The distinct count shuffles on (variant, session) first, so a variant
    holding most of the sessions is spread over all tasks. Local dates rise
    with the timestamp, so only the two extremes are converted.
    """
    pings = within_local_period(events.where("tipo = 'etapa' and variante != ''"), period)
    seen = of_page_group(pings, pages, funnel, source).groupBy("variante").agg(
        F.expr("count(distinct sessao) as sessoes"),
        F.expr("min(ts) as _ini"),
        F.expr("max(ts) as _fim"),
    )
    return seen.selectExpr(
        "variante", "sessoes", f"{local_date('_ini')} as ini", f"{local_date('_fim')} as fim"
    ).orderBy(F.desc("sessoes"), "variante")


#: Sketches of 2 ** 14 registers: a standard error of 0.8 %.
SKETCH_BITS = 14


def variant_days(events: DataFrame) -> DataFrame:
    """Per local day, variant and page: a sketch of its sessions that merges with others. One row a day and group, whatever it holds."""
    pings = events.where("tipo = 'etapa' and variante != ''").selectExpr("*", f"{local_date('ts')} as dia")
    return pings.groupBy("dia", "variante", "pagina").agg(F.expr(f"hll_sketch_agg(sessao, {SKETCH_BITS}) as sessoes"))


def variants_of_days(
    days: DataFrame, pages: DataFrame | None = None, period: Period = EVERYTHING, funnel: str | None = None, source: str | None = None
) -> DataFrame:
    """As ``variants_available``, with sessions estimated from merged sketches: no ping is read or counted again."""
    kept = of_page_group(within_dates(days, period, "dia"), pages, funnel, source)
    merged = kept.groupBy("variante").agg(
        F.expr("hll_sketch_estimate(hll_union_agg(sessoes)) as sessoes"), F.expr("min(dia) as ini"), F.expr("max(dia) as fim")
    )
    return merged.orderBy(F.desc("sessoes"), "variante")


# --- several periods --------------------------------------------------------
def funnel_by_period(pings: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    """Funnel totals and percentages for each of many periods, empty ones included."""
    return _period_totals(sessions_by_period(pings, periods), periods)


def funnel_by_period_of_days(days: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    """The same out of session-days; no ping is read."""
    return _period_totals(day_sessions_by_period(days, periods), periods)


def _period_totals(sessions: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    totals = funnel_totals(sessions, "preset").drop("etapas")
    spine = period_table(sessions.sparkSession, periods)
    return percentages(spine.join(totals, "preset", "left").na.fill(0, ["visitantes", "compraram", "fim"]))


def pings_by_period(events: DataFrame, periods: Mapping[str, Period]) -> DataFrame:
    """How many pings fall into each period: one scan of the periods' hull, one row per task."""
    events = within_local_period(events, hull(periods))
    counts, rows = [], []
    for i, (name, period) in enumerate(periods.items()):
        counts.append(F.expr(f"count_if({in_local_period(period)}) as _{i}"))
        rows.append(f"named_struct('preset', '{name}', 'pings', _{i})")
    found = events.agg(*counts).selectExpr(f"inline(array({', '.join(rows)}))")
    return period_table(events.sparkSession, periods).join(found, "preset")
