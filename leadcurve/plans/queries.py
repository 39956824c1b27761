"""Every query by name, wired to the driver's tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.operators import creatives as cr
from leadcurve.operators import events as ev
from leadcurve.operators import funnel as fn
from leadcurve.operators import insights as ins
from leadcurve.operators import merges, periods, reports
from leadcurve.plans.load import AUDIT_KEY, DAILY, HOURLY, HOURLY_KEY, LoadRules, load_audit, refresh_ads
from leadcurve.sources import dimensions, keyed, schemas, snapshots
from leadcurve.sources import driver_tables as drv
from leadcurve.sources.local import local_table
from leadcurve.sources.tables import (
    drop_folder,
    read_creative_sheet,
    read_insights,
    replace_days,
    work_folder,
    write_by_month,
    write_insights,
)
from leadcurve.streaming import pings as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOAD_TIME = dt.datetime(2001, 7, 31, 12, 0)
MEDAL_MONTH = periods.between("2001-07-01", "2001-07-31")
FUNNEL_PERIOD = periods.between("2024-01-05", "2024-01-20")
REPORT_PERIOD = periods.between("2000-01-01", "2001-03-31")


def portable(df: DataFrame) -> DataFrame:
    """Column types that every engine prints alike.

    Only for comparing results: the operators themselves keep decimals and dates.
    """
    as_type = {"decimal": "double", "date": "string", "smallint": "int", "timestamp": "string"}
    return df.select(
        *[
            F.col(name).cast(as_type[kind]) if (kind := t.split("(")[0].split("_")[0]) in as_type else name
            for name, t in df.dtypes
        ]
    )


def query(run: Query) -> Query:
    QUERIES[run.__name__] = lambda spark, folder: portable(run(spark, folder))
    return run


# --- funnel -----------------------------------------------------------------
@query
def funnel_summary(spark, folder):
    return fn.percentages(fn.funnel(drv.events(spark, folder))).drop("etapas")


@query
def funnel_steps(spark, folder):
    return fn.steps(fn.funnel(drv.events(spark, folder)))


@query
def funnel_json(spark, folder):
    return fn.as_json(fn.funnel(drv.events(spark, folder)))


@query
def funnel_retention(spark, folder):
    return fn.retention(fn.funnel(drv.events(spark, folder)))


@query
def funnel_alerts(spark, folder):
    return fn.alerts(fn.retention(fn.funnel(drv.events(spark, folder))))


@query
def funnel_biggest_drop(spark, folder):
    found = fn.biggest_drop(fn.retention(fn.funnel(drv.events(spark, folder))))
    return found.withColumn("alertas", F.array_join("alertas", ","))


@query
def funnel_local_period(spark, folder):
    return fn.steps(fn.funnel(drv.events(spark, folder), period=FUNNEL_PERIOD))


@query
def funnel_variant_filter(spark, folder):
    return fn.steps(fn.funnel(drv.events(spark, folder), variants=["v0", "v2"]))


@query
def funnel_page_filter(spark, folder):
    found = fn.funnel(
        drv.events(spark, folder), dimensions.pages(spark), funnel="brasil", source="meta"
    )
    return fn.steps(found)


@query
def funnel_latam_period(spark, folder):
    found = fn.funnel(
        drv.events(spark, folder),
        dimensions.pages(spark),
        FUNNEL_PERIOD,
        variants=["v0", "v1"],
        funnel="latam",
    )
    return fn.percentages(found).drop("etapas")


def _sheet(spark, folder):
    rows = drv.event_sheet(spark, folder)
    return rows.withColumn("ts", F.expr(ev.utc_timestamp("ts")))


@query
def funnel_sheet_mode(spark, folder):
    return fn.steps(fn.funnel_totals(fn.sheet_sessions(_sheet(spark, folder))))


@query
def funnel_sheet_period(spark, folder):
    sessions = fn.sheet_sessions(_sheet(spark, folder), FUNNEL_PERIOD)
    return fn.percentages(fn.funnel_totals(sessions)).drop("etapas")


@query
def variants_available(spark, folder):
    return fn.variants_available(drv.events(spark, folder))


@query
def variants_in_period(spark, folder):
    return fn.variants_available(
        drv.events(spark, folder), dimensions.pages(spark), FUNNEL_PERIOD, "brasil", "meta"
    )


@query
def period_presets(spark, folder):
    return fn.pings_by_period(drv.events(spark, folder), periods.presets(drv.EVENT_DAY))


@query
def funnel_by_preset(spark, folder):
    pings = fn.stage_pings(drv.events(spark, folder))
    return fn.funnel_by_period(pings, periods.presets(drv.EVENT_DAY))


# --- cleaning ---------------------------------------------------------------
@query
def events_clean(spark, folder):
    return ev.accepted(ev.clean_events(drv.event_sheet(spark, folder)))


@query
def event_rejects(spark, folder):
    return ev.reject_counts(ev.clean_events(drv.event_sheet(spark, folder)))


@query
def event_rejects_table_checks(spark, folder):
    return ev.reject_counts(ev.clean_events(drv.event_sheet(spark, folder), table_checks=True))


@query
def event_table_checks(spark, folder):
    """Uncleaned rows against the limits of the event table."""
    typed = drv.event_sheet(spark, folder).selectExpr(
        "sessao",
        "tipo",
        f"{ev.clamped_leading_int('etapa')} as etapa",
        "if(tipo = 'respostas', null, data) as variante",
        "pagina",
    )
    return ev.reject_counts(ev.check_events(typed))


@query
def cost_rejects(spark, folder):
    return ev.reject_counts(ev.check_costs(drv.costs(spark, folder)))


# --- insights ---------------------------------------------------------------
@query
def insights_actions(spark, folder):
    parsed = ins.parse_insights(drv.nested_insights(spark, folder))
    return parsed.groupBy("ad_id").agg(
        F.count("*").alias("linhas"),
        *[F.expr(f"sum({c}) as {c}") for c in ins.COUNTS],
        *[F.expr(f"{reports.sum_money(c)} as {c}") for c in ins.AMOUNTS],
    )


@query
def insights_json(spark, folder):
    """Nested records exported as JSON lines, read back under the declared schema and loaded."""
    export = work_folder(spark, "insights")
    write_insights(drv.nested_insights(spark, folder), export)
    parsed = ins.parse_insights(read_insights(spark, export))
    return ins.daily_facts(drv.loaded_rows(spark, parsed))


@query
def ad_daily(spark, folder):
    return drv.ad_daily(spark, folder)


@query
def ad_hourly(spark, folder):
    return drv.ad_hourly(spark, folder)


@query
def ad_daily_repeats(spark, folder):
    return ev.repeated_keys(drv.sheet_daily(spark, folder), "data", "anuncio")


def _rollup(spark, folder):
    return ins.ad_rollup(drv.loaded_rows(spark, drv.insights(spark, folder)), drv.AD_DAY)


@query
def ad_rollup_status(spark, folder):
    return cr.rollup_status(_rollup(spark, folder), drv.creatives(spark, folder))


# --- creatives --------------------------------------------------------------
def _metrics(spark, folder, period=periods.EVERYTHING):
    return cr.creative_metrics(
        drv.creatives(spark, folder), drv.ad_daily(spark, folder), drv.aliases(spark), period
    )


def _sheet_report(spark, folder, period=periods.EVERYTHING):
    return cr.creative_report(
        cr.sheet_metrics(drv.creatives(spark, folder), drv.sheet_daily(spark, folder), period)
    )


@query
def creative_metrics(spark, folder):
    return _metrics(spark, folder)


@query
def creative_metrics_period(spark, folder):
    return _metrics(spark, folder, REPORT_PERIOD)


@query
def creative_metrics_sheet_mode(spark, folder):
    return cr.sheet_metrics(
        drv.creatives(spark, folder), drv.sheet_daily(spark, folder), REPORT_PERIOD
    )


@query
def creative_report(spark, folder):
    return _sheet_report(spark, folder)


@query
def creative_report_period(spark, folder):
    return _sheet_report(spark, folder, MEDAL_MONTH)


@query
def creative_report_database(spark, folder):
    return cr.creative_report(_metrics(spark, folder))


@query
def creative_medals(spark, folder):
    rules = medal_rules(dimensions.config(spark))
    return cr.with_medals(_metrics(spark, folder, MEDAL_MONTH), rules)


def medal_rules(config: DataFrame) -> DataFrame:
    """The rule array stored under ``medalhas``: one row."""
    stored = config.where(F.col("chave") == "medalhas")
    return stored.select(F.from_json("valor", schemas.MEDAL_RULES).alias("regras"))


# --- reports ----------------------------------------------------------------
@query
def daily_series(spark, folder):
    return reports.daily_series(drv.ad_daily(spark, folder), REPORT_PERIOD)


@query
def hourly_series(spark, folder):
    return reports.hourly_series(drv.ad_hourly(spark, folder))


@query
def tag_report(spark, folder):
    return reports.tag_report(_sheet_report(spark, folder), ["formato", "angulo", "emocao"])


@query
def tag_metric_matrix(spark, folder):
    return reports.tag_metric_matrix(_sheet_report(spark, folder))


@query
def tag_negative_roi(spark, folder):
    return reports.tag_negative_roi(_sheet_report(spark, folder))


@query
def kpi_totals(spark, folder):
    return reports.kpi_totals(_sheet_report(spark, folder))


@query
def top_creatives(spark, folder):
    return reports.top_creatives(_sheet_report(spark, folder))


@query
def costs_in_period(spark, folder):
    return reports.costs_in_period(
        drv.costs(spark, folder), periods.between("1997-01-01", "1997-12-31")
    )


# --- table upkeep -----------------------------------------------------------
@query
def creative_upsert(spark, folder):
    return cr.upsert_creatives(drv.creatives(spark, folder), _rollup(spark, folder), LOAD_TIME)


@query
def creative_upsert_sheet_mode(spark, folder):
    # under canonical names, of which one is in no creative row
    rollup = ins.ad_rollup(ins.with_canonical_name(_sheet_rows(spark, folder), drv.aliases(spark)), drv.AD_DAY)
    return cr.insert_new_creatives(drv.creatives(spark, folder), rollup, LOAD_TIME)


def _sheet_rows(spark, folder):
    return ins.kept_rows(drv.insights(spark, folder), drv.CAMPAIGN_TEXT, drv.EXCLUDED_CAMPAIGNS, drv.EXCLUDED_ADS)


@query
def creative_sheet_refresh(spark, folder):
    """The wide sheet with last time's hook rate; one ad of the facts is not listed."""
    listed = drv.creatives(spark, folder)
    sheet = read_creative_sheet(listed.withColumn("atualizado", F.lit("antes")).withColumn("hook_rate_pct", F.lit(1.5)))
    rows = ins.with_canonical_name(_sheet_rows(spark, folder), drv.aliases(spark))
    return cr.refresh_sheet(sheet, rows, ins.ad_rollup(rows, drv.AD_DAY), LOAD_TIME)


@query
def daily_rewrite(spark, folder):
    """Two loads into the same table: the second one replaces the first."""
    target = work_folder(spark, "criativos_diario")
    for _ in range(2):
        write_by_month(drv.ad_daily(spark, folder), target, "data", "anuncio")
    return spark.read.parquet(target).drop("mes")


@query
def hourly_replace(spark, folder):
    """Two loads three days apart: days that left the window stay as first loaded."""
    target = work_folder(spark, "criativos_hora")
    insights = drv.insights(spark, folder)
    for today in (drv.AD_DAY - dt.timedelta(days=3), drv.AD_DAY):
        window = ins.hourly_window(today)
        fresh = ins.hourly_facts(ins.kept_rows(insights, drv.CAMPAIGN_TEXT, period=window))
        replace_days(fresh, target, window)
    return spark.read.parquet(target)


@query
def seed_insert(spark, folder):
    """Ads seen in the facts are added to the creatives; one name is in no creative row."""
    stored = drv.creatives(spark, folder)
    seen = ins.with_canonical_name(drv.insights(spark, folder), drv.aliases(spark))
    seeds = seen.select("anuncio").distinct().withColumn("status", F.lit("novo"))
    return merges.insert_missing(stored, seeds, "anuncio").select("anuncio", "campanha", "status", "formato")


@query
def status_backfill(spark, folder):
    return cr.rename_running(drv.creatives(spark, folder)).select("anuncio", "status")


@query
def creative_sheet_layout(spark, folder):
    """A sheet of the oldest layout, some rows nameless, brought to the current one."""
    old = drv.creatives(spark, folder).select(
        "ad_id",
        F.when(F.col("estrutura") == "", "").otherwise(F.col("anuncio")).alias("anuncio"),
        "campanha", "status", "formato", "angulo", "hook", "emocao", "estrutura",
    )
    return read_creative_sheet(old)


@query
def cost_changes(spark, folder):
    """Costs of finished orders deleted, pending ones raised, open urgent ones added anew."""
    stored, changes = _cost_changes(spark, folder)
    return merges.apply_changes(stored, changes, "id")


@query
def cost_change_rejects(spark, folder):
    """Changes without effect: broken costs, repeated keys, wrong operations."""
    stored, changes = _cost_changes(spark, folder, valid=False)
    checked = ev.check_costs(changes).withColumn("motivo", F.expr("if(op = 'delete', null, motivo)"))
    broken = checked.where("motivo is not null").groupBy("motivo").agg(F.count("*").alias("mudancas"))
    _, good = _cost_changes(spark, folder)
    refused = merges.change_rejects(stored, good, "id").groupBy("motivo").agg(F.sum("mudancas").alias("mudancas"))
    return broken.unionByName(refused).groupBy("motivo").agg(F.sum("mudancas").alias("mudancas"))


def _cost_changes(spark, folder, valid=True):
    """The costs and a batch of changes with planted faults; only valid costs are written."""
    stored = drv.costs(spark, folder)
    orders = drv.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_orderpriority"
    )
    urgent = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    op = (
        F.when(F.col("o_orderstatus") == "F", "delete")
        .when(F.col("o_orderstatus") == "P", "update")
        .when(urgent, "insert")
    )
    changes = (
        stored.join(orders, "id")
        .withColumn("op", op)
        .where(F.col("op").isNotNull())
        .select(
            F.when(F.col("op") == "insert", F.concat(F.lit("n"), F.col("id")))
            .otherwise(F.col("id"))
            .alias("id"),
            "nome",
            F.when(F.col("op") == "update", F.col("valor") + 10)
            .otherwise(F.col("valor"))
            .cast("decimal(12,2)")
            .alias("valor"),
            "data",
            "op",
        )
    )
    number = F.expr("cast(regexp_extract(id, '[0-9]+', 0) as bigint)")
    copy = F.when(number % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changes = (
        changes.withColumn("copia", F.explode(copy))  # every seventh change comes twice
        .withColumn("id", F.when(number % 11 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")))  # of no stored cost
        .withColumn("op", F.when((number % 13 == 0) & (F.col("op") == "update"), "insert").otherwise(F.col("op")))
        .drop("copia")
    )
    if valid:
        changes = ev.check_costs(changes).where("op = 'delete' or motivo is null").drop("motivo")
    return stored, changes


@query
def load_summary(spark, folder):
    """Audit row of a load: rows read, days, creatives and hours written."""
    read = ins.kept_rows(
        drv.insights(spark, folder), drv.CAMPAIGN_TEXT, period=ins.daily_window(drv.AD_DAY)
    )
    staging = work_folder(spark, "registros")
    ins.combine_rows(read).write.parquet(staging)
    combined = spark.read.parquet(staging)
    named = drv.loaded_rows(spark, combined)
    return load_audit(
        combined,
        ins.daily_facts(named),
        ins.ad_rollup(named, drv.AD_DAY).where("impressoes > 0"),
        drv.ad_hourly(spark, folder),
        drv.AD_DAY,
        LOAD_TIME,
    )


HOUR_FIELD = "hourly_stats_aggregated_by_advertiser_time_zone"
AD_RULES = LoadRules(drv.CAMPAIGN_TEXT, drv.EXCLUDED_CAMPAIGNS, drv.EXCLUDED_ADS)


def _exports(spark, records: DataFrame, part: str = "") -> tuple[str, str]:
    """Records as JSON lines, daily and hourly; hourly ones have only the fields that are asked for."""
    days, hours = work_folder(spark, f"export-dias{part}"), work_folder(spark, f"export-horas{part}")
    write_insights(records, days)
    write_insights(records.select("date_start", HOUR_FIELD, "ad_name", "spend", "actions", "action_values"), hours)
    return days, hours


def _refresh(spark, folder, root, exports, version) -> snapshots.Config:
    return refresh_ads(spark, root, *exports, drv.creatives(spark, folder), drv.aliases(spark), version, drv.AD_DAY, LOAD_TIME, AD_RULES)


@query
def load_job(spark, folder):
    """The whole load, twice, over exported records; the second run finds every day as it was."""
    exports, root = _exports(spark, drv.nested_insights(spark, folder)), work_folder(spark, "tabelas")
    for version in ("v1", "v2"):
        config = _refresh(spark, folder, root, exports, version)
    for export in exports:
        drop_folder(spark, export)
    none = "cast(null as {}) as {}".format
    facts = "gasto, valor, checkouts, vendas"
    daily = snapshots.read_days(spark, root, DAILY, drv.ad_daily(spark, folder).schema, config.days(DAILY))
    hourly = snapshots.read_days(spark, root, HOURLY, drv.ad_hourly(spark, folder).schema, config.days(HOURLY))
    creatives = spark.read.parquet(f"{root}/criativos/versao={config.days('criativos')['versao']}")
    tables = [
        ("diario", daily, f"data, {none('int', 'hora')}, anuncio, {facts}, {none('string', 'texto')}"),
        ("horario", hourly, f"data, hora, anuncio, {facts}, {none('string', 'texto')}"),
        ("criativos", creatives, f"{none('date', 'data')}, {none('int', 'hora')}, anuncio, {', '.join(none('decimal(18,2)', c) for c in ('gasto', 'valor'))}, {none('bigint', 'checkouts')}, {none('bigint', 'vendas')}, status as texto"),
    ]
    rows = [df.selectExpr(f"'{name}' as tabela", *sql_list(columns)) for name, df, columns in tables]
    fields = "ok", "linhas_meta", "dias_gravados", "criativos", "horas_gravadas"
    audit = config.table(spark).where(F.col("chave") == AUDIT_KEY).select(
        F.concat_ws("|", *[F.get_json_object("valor", f"$.{f}") for f in fields]).alias("texto")
    )
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.unionByName(audit.withColumn("tabela", F.lit("auditoria")), allowMissingColumns=True)


@query
def load_incremental(spark, folder):
    """Audits of three loads: all days, the same export again, and one without an ad, with broken lines and a number too large."""
    records, root = drv.nested_insights(spark, folder), work_folder(spark, "tabelas")
    audits = []

    def load(exports: tuple, version: str) -> None:
        audit = _refresh(spark, folder, root, exports, version).value(AUDIT_KEY, {})
        audits.append((version, *[audit[k] for k in ("dias_regravados", "dias_gravados", "linhas_malformadas", "linhas_recusadas")]))

    # three ads are read out once for what is made of their records alone
    few = work_folder(spark, "anuncios")
    records.where("coalesce(ad_id in ('5', '7', '8'), true)").write.parquet(few)
    some = spark.read.schema(records.schema).parquet(few)
    # the ad that goes has folders of its own, so that all other records are exported once
    without, gone = _exports(spark, records.where("ad_id != '5'")), _exports(spark, some.where("not coalesce(ad_id != '5', false)"), "-5")
    for version in ("v1", "v2"):
        load(tuple(zip(without, gone, strict=True)), version)
    broken = some.where("ad_id = '7'").selectExpr("""concat('{"date_start": "', date_start) as value""")
    broken.write.mode("append").text(without[0])
    some.where("ad_id = '8'").withColumn("clicks", F.lit("1e30")).write.mode("append").json(without[0])
    for path in (*gone, few):
        drop_folder(spark, path)
    load(without, "v3")
    for path in without:
        drop_folder(spark, path)
    return local_table(spark, "versao string, dias_regravados bigint, dias_gravados bigint, linhas_malformadas bigint, linhas_recusadas bigint", audits)


@query
def creative_keyed_refresh(spark, folder):
    """Two loads of one roll-up into creatives laid out by name; each shuffles the roll-up alone."""
    root = work_folder(spark, "tabelas")
    keyed.write_keyed(drv.creatives(spark, folder), root, "criativos", "antes", ["anuncio"])
    for version in ("v1", "v2"):
        keyed.refresh_keyed(spark, root, "criativos", version, lambda stored: cr.upsert_creatives(stored, _rollup(spark, folder), LOAD_TIME))
    return keyed.read_keyed(spark, root, "criativos")


@query
def cost_keyed_changes(spark, folder):
    """A batch of changes to costs laid out by id."""
    root = work_folder(spark, "tabelas")
    stored, changes = _cost_changes(spark, folder)
    keyed.write_keyed(stored, root, "custos", "antes", ["id"])
    keyed.refresh_keyed(spark, root, "custos", "v1", lambda table: merges.apply_changes(table, changes, "id"))
    return keyed.read_keyed(spark, root, "custos")


@query
def hourly_snapshot(spark, folder):
    """Two loads three days apart; a reader that began before the second still sees all of the first."""
    root, insights = work_folder(spark, "tabelas"), drv.insights(spark, folder)
    seen = {}
    for reader, today in (("antes", drv.AD_DAY - dt.timedelta(days=3)), ("depois", drv.AD_DAY)):
        window = ins.hourly_window(today)
        fresh = ins.hourly_facts(ins.kept_rows(insights, drv.CAMPAIGN_TEXT, period=window))
        snapshots.replace_period(fresh, root, HOURLY, reader, window, HOURLY_KEY)
        seen[reader] = snapshots.read_days(spark, root, HOURLY, fresh.schema, snapshots.read_config(spark, root).days(HOURLY))
    parts = [df.withColumn("leitura", F.lit(reader)) for reader, df in seen.items()]
    return parts[0].unionByName(parts[1])


@query
def hourly_key_rejects(spark, folder):
    """Hours of which every sixth comes twice are refused as a whole; the report names them, the table stays empty."""
    root, window = work_folder(spark, "tabelas"), ins.hourly_window(drv.AD_DAY)
    fresh = drv.ad_hourly(spark, folder)
    twice = fresh.unionByName(fresh.where("hora % 6 = 0"))
    try:
        snapshots.replace_period(twice, root, HOURLY, "v1", window, HOURLY_KEY)
    except snapshots.RefusedWrite as refused:
        left = len(snapshots.read_config(spark, root).days(HOURLY))
        return refused.report.withColumn("dias_na_tabela", F.lit(left))
    return fresh.limit(0).selectExpr(*HOURLY_KEY, "0L as linhas", "0 as dias_na_tabela")


def sql_list(columns: str) -> list[str]:
    """Expressions separated by commas outside brackets."""
    return re.split(r", (?![^(]*\))", columns)


@query
def ad_daily_combined(spark, folder):
    """The daily facts out of combined rows: the same as from single ones."""
    return ins.daily_facts(drv.loaded_rows(spark, ins.combine_rows(drv.insights(spark, folder))))


# --- streams ----------------------------------------------------------------
def _event_files(spark, folder):
    schema = drv.table(spark, folder, "events").schema
    return st.file_stream(spark, folder, schema, "events*.parquet")


def _stored_events(spark, target):
    stored = spark.read.parquet(target)
    return stored.select("id", "ts", "sessao", "tipo", "etapa", "variante", "pagina", "dados")


@query
def stream_ingest(spark, folder):
    target, checkpoint = work_folder(spark, "eventos"), work_folder(spark, "posicao")
    for _ in range(2):
        st.ingest(drv.as_pings(_event_files(spark, folder)), target, checkpoint).awaitTermination()
    return _stored_events(spark, target)


@query
def ingest_rejects(spark, folder):
    """Pings that the ingest refuses, by reason; a second run adds nothing."""
    target, rejects, checkpoint = (work_folder(spark, name) for name in ("eventos", "recusados", "posicao"))
    for _ in range(2):
        st.ingest(drv.as_pings(_event_files(spark, folder)), target, checkpoint, rejects=rejects).awaitTermination()
    return spark.read.parquet(rejects).groupBy("motivo").agg(F.count("*").alias("linhas"))


@query
def stream_page_funnel(spark, folder):
    """Funnel of one page group out of streamed pings."""
    target, checkpoint = work_folder(spark, "eventos"), work_folder(spark, "posicao")
    st.ingest(drv.as_pings(_event_files(spark, folder)), target, checkpoint).awaitTermination()
    found = fn.funnel(_stored_events(spark, target), dimensions.pages(spark), funnel="brasil", source="tiktok")
    return fn.percentages(found).drop("etapas")


@query
def stream_compacted_funnel(spark, folder):
    """Funnel out of compacted session-days, with a batch that came after the compaction."""
    parts, compact = work_folder(spark, "sessoes"), work_folder(spark, "sessoes-compactas")
    checkpoint = work_folder(spark, "posicao")
    events = drv.as_events(_event_files(spark, folder))
    st.track_sessions(events.where("id % 3 != 0"), parts, checkpoint).awaitTermination()
    st.compact_session_days(spark.read.parquet(parts), compact)
    late = work_folder(spark, "sessoes-novas")
    st.track_sessions(events.where("id % 3 = 0"), late, work_folder(spark, "posicao")).awaitTermination()
    columns = "dia", "variante", "pagina", "sessao", "maxi", "comprou"
    partials = spark.read.parquet(compact).select(*columns).unionByName(spark.read.parquet(late).select(*columns))
    return fn.percentages(fn.funnel_totals(st.tracked_sessions(partials))).drop("etapas")


@query
def stream_compacted_events(spark, folder):
    """Events after a compaction, a replay of what it covers, its removal, and pings that came later."""
    target, root = work_folder(spark, "eventos"), work_folder(spark, "tabelas")
    pings = drv.as_pings(_event_files(spark, folder))
    early, late = pings.where("id % 3 != 0"), pings.where("id % 3 = 0")
    st.ingest(early, target, work_folder(spark, "posicao")).awaitTermination()
    st.compact_events(spark, target, root)
    st.ingest(early, target, work_folder(spark, "posicao")).awaitTermination()  # the same batch numbers once more
    st.retire_compacted(spark, target, root)
    st.ingest(late, target, work_folder(spark, "posicao"), origin="tarde").awaitTermination()
    return st.read_events(spark, target, root).select("id", "ts", "sessao", "tipo", "etapa", "variante", "pagina", "dados")


@query
def stream_state_store(spark, folder):
    """Funnel out of the session-days of a state store; a second stream brings late pings and repeats."""
    root = work_folder(spark, "tabelas")
    events = drv.as_events(_event_files(spark, folder))
    for rows, origin in ((events.where("id % 3 != 0"), "pings"), (events.where("id % 3 != 1"), "tarde")):
        st.keep_sessions(rows, root, work_folder(spark, "posicao"), origin).awaitTermination()
    return fn.percentages(fn.funnel_totals(st.tracked_sessions(st.kept_sessions(spark, root)))).drop("etapas")


@query
def funnel_presets_of_days(spark, folder):
    """All presets out of stored session-days, without a look at the events."""
    stored = work_folder(spark, "sessoes-dia")
    st.compact_session_days(st.session_days(drv.events(spark, folder)), stored)
    return fn.funnel_by_period_of_days(spark.read.parquet(stored), periods.presets(drv.EVENT_DAY))


@query
def variants_sketch(spark, folder):
    """Variants of a period out of stored sketches; ``perto``: within 3 % of the exact count."""
    stored = work_folder(spark, "variantes-dia")
    fn.variant_days(drv.events(spark, folder)).write.parquet(stored)
    found = fn.variants_of_days(spark.read.parquet(stored), dimensions.pages(spark), FUNNEL_PERIOD, "brasil", "meta")
    exact = variants_in_period(spark, folder).selectExpr("variante", "sessoes as exatas")
    return found.join(exact, "variante").selectExpr("variante", "abs(sessoes - exatas) <= 0.03 * exatas as perto", "ini", "fim")


@query
def events_clean_period(spark, folder):
    """Cleaned events of a period; the raw time prunes the scan."""
    return ev.events_of_period(drv.event_sheet(spark, folder), FUNNEL_PERIOD)


@query
def stream_session_state(spark, folder):
    target, checkpoint = work_folder(spark, "sessoes"), work_folder(spark, "posicao")
    for _ in range(2):
        events = drv.as_events(_event_files(spark, folder))
        st.track_sessions(events, target, checkpoint).awaitTermination()
    return st.tracked_sessions(spark.read.parquet(target))


@query
def stream_session_funnel(spark, folder):
    """Funnel of a period, variants and funnel group out of the tracked session-days."""
    target, checkpoint = work_folder(spark, "sessoes"), work_folder(spark, "posicao")
    events = drv.as_events(_event_files(spark, folder))
    st.track_sessions(events, target, checkpoint).awaitTermination()
    sessions = st.tracked_sessions(
        spark.read.parquet(target),
        dimensions.pages(spark),
        FUNNEL_PERIOD,
        variants=["v0", "v1"],
        funnel="latam",
    )
    return fn.percentages(fn.funnel_totals(sessions)).drop("etapas")


@query
def backfill_resume(spark, folder):
    """History arriving in two parts; each run goes on where the last one stopped."""
    source = work_folder(spark, "historico")
    target, checkpoint = work_folder(spark, "eventos"), work_folder(spark, "posicao")
    raw = drv.table(spark, folder, "events")
    answers = F.col("event_type") == "error"
    for part in (raw.where(answers), raw.where(~answers | answers.isNull())):
        rows = drv.as_event_sheet(part)
        rows.write.mode("append").parquet(source)
        stream = st.file_stream(spark, source, rows.schema)
        st.backfill(stream, target, checkpoint).awaitTermination()
    st.backfill(st.file_stream(spark, source, rows.schema), target, checkpoint).awaitTermination()
    return _stored_events(spark, target)


@query
def backfill_report(spark, folder):
    """Kept and skipped history rows over two runs; the second finds nothing new."""
    target, rejects, checkpoint = (work_folder(spark, name) for name in ("eventos", "recusados", "posicao"))
    for _ in range(2):
        sheet = drv.as_event_sheet(_event_files(spark, folder))
        st.backfill(sheet, target, checkpoint, rejects=rejects).awaitTermination()
    return st.batch_report(spark.read.parquet(target), spark.read.parquet(rejects))
