"""The driver's tables in the shapes the operators take.

The mapping texts are those of FIXTURES.md, one per column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.operators.insights import (
    daily_facts,
    daily_window,
    hourly_facts,
    hourly_window,
    kept_rows,
    with_canonical_name,
)
from leadcurve.sources import dimensions

EVENT_DAY = dt.date(2024, 1, 30)
AD_DAY = dt.date(2001, 7, 31)
CAMPAIGN_TEXT = "Quiz"
EXCLUDED_CAMPAIGNS = ("13",)
EXCLUDED_ADS = ("17",)
ALIASES = (
    ("Supplier#000000001", "Supplier#000000000"),
    ("Supplier#000000002", "Supplier#000000000"),
)


# declared, so that opening a table starts no job
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def aliases(spark: SparkSession) -> DataFrame:
    return dimensions.aliases(spark, ALIASES)


# --- pings ------------------------------------------------------------------
# 1 + k % 35 with 11..13 folded into 10 and 21..23 into 20. A lookup names the
# parsed JSON once; a CASE would parse it again in every branch of a pushed filter.
_FOLDED = [1 + (10 if 10 <= r <= 13 else 20 if 20 <= r <= 23 else r) for r in range(35)]
_K = "cast(get_json_object(props, '$.k') as int)"
_STAGE = f"get(array({', '.join(map(str, _FOLDED))}), {_K} % 35)"
_PAGE = (
    "case user_id % 5 when 0 then 'v2' when 1 then 'tiktok' when 2 then 'espanhol' "
    "when 3 then null else 'zz' end"
)
_TYPE = "case when event_type = 'error' then 'respostas' else 'etapa' end"


def as_events(raw: DataFrame) -> DataFrame:
    """Driver events, batch or stream, as typed pings."""
    return raw.selectExpr(
        "event_id as id",
        "ts",
        "concat('sess-', cast(user_id as string), '-', cast(cast(ts as date) as string)) as sessao",
        f"{_TYPE} as tipo",
        f"{_STAGE} as etapa",
        "case user_id % 4 when 3 then null else concat('v', cast(user_id % 4 as string)) end as variante",
        f"{_PAGE} as pagina",
        "case when event_type = 'error' then props end as dados",
    )


def as_pings(raw: DataFrame) -> DataFrame:
    """Driver events as the request parameters of pings."""
    return raw.selectExpr(
        "event_id as id",
        "ts as recebido",
        "case when event_type = 'error' then 'respostas' end as action",
        "concat('sess-', cast(user_id as string)) as sessao",
        f"case when event_type = 'view' and {_K} < 5 then '' else cast({_STAGE} as string) end as etapa",
        "case when event_id % 50 = 10 then repeat('v', 30) when user_id % 4 = 3 then '' "
        "else cast(user_id % 4 as string) end as v",
        "case when event_type = 'error' then props end as data",
        f"{_PAGE} as pagina",
    )


def as_event_sheet(raw: DataFrame) -> DataFrame:
    """Driver events as text rows with planted faults."""
    return raw.selectExpr(
        "event_id as id",
        "case when event_id % 50 = 3 then 'bad' "
        "when event_id % 50 = 15 then date_format(ts, 'yyyy/MM/dd HH:mm:ss') "
        "when event_id % 50 = 16 then date_format(ts, 'EEE MMM dd yyyy HH:mm:ss') "
        "when event_id % 50 = 17 then concat(date_format(ts, 'EEE MMM dd yyyy HH:mm:ss'), ' GMT-0300 (x)') "
        "when event_id % 50 = 18 then date_format(ts, 'MMM d, yyyy HH:mm:ss') "
        "when event_id % 50 = 19 then date_format(ts, 'M/d/yyyy h:mm:ss a') "
        "when event_id % 50 = 20 then concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT') "
        "else cast(ts as string) end as ts",
        "case event_id % 50 when 0 then 'abc' when 5 then concat('  u', cast(user_id as string), '-abc ') "
        "when 6 then repeat('s', 65) else concat('sess-', cast(user_id as string)) end as sessao",
        f"case event_id % 50 when 1 then 'outro' when 7 then '' else {_TYPE} end as tipo",
        "case event_id % 50 when 2 then 'x' when 4 then '12abc' when 8 then '41' when 9 then '' "
        "else case when event_id % 50 = 14 and event_type = 'error' then '99999999999' else cast(1 + event_id % 35 as string) end end as etapa",
        "case when event_id % 50 = 10 then repeat('v', 30) when event_id % 50 = 11 then '' "
        "when event_type = 'error' and event_id % 3 = 1 then '{\"k\":1,\"k\":2}' "
        "when event_type = 'error' then props else concat('v', cast(user_id % 4 as string)) end as data",
        "case event_id % 50 when 12 then '' when 13 then repeat('p', 25) else 'v2' end as pagina",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(table(spark, folder, "events"))


def event_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return as_event_sheet(table(spark, folder, "events"))


# --- ads --------------------------------------------------------------------
def _with_ad(spark: SparkSession, folder: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows joined to their supplier, its nation and region, one table after the other.

    Each joined table is a plain scan whose size Catalyst knows, so each is
    broadcast if it is small and only then; a join of joins would be
    guessed far too large and make the facts move instead.
    """
    if key != "s_suppkey":
        rows = rows.join(table(spark, folder, "supplier"), F.expr(f"{key} = s_suppkey"))
    return rows.join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey")).join(
        table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey")
    )


_CAMPAIGN = "concat(case when r_regionkey = 4 then 'Outro/' else 'Quiz/' end, n_name)"


def insights(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as flat ad-insight rows."""
    rows = _with_ad(spark, folder, table(spark, folder, "lineitem"), "l_suppkey")
    two_digits = "lpad(cast(l_orderkey % 24 as string), 2, '0')"
    flat = rows.withColumn("_q", F.col("l_quantity").cast("bigint")).selectExpr(
        "cast(l_shipdate as date) as data",
        "case when l_orderkey % 500 = 499 then '' "
        f"else concat({two_digits}, ':00:00 - ', {two_digits}, ':59:59') end as hora_texto",
        "cast(l_suppkey as string) as ad_id",
        "case when l_suppkey % 11 = 10 then null else s_name end as ad_name",
        "cast(s_nationkey as string) as campaign_id",
        f"{_CAMPAIGN} as campaign_name",
        "cast(cast(floor(l_extendedprice) as decimal(9,0)) * 0.001 * cast(1 + l_suppkey % 7 as decimal(1,0)) "
        "as decimal(12,2)) as gasto",
        "case when l_suppkey % 50 = 49 then 0 else _q * (60 + 20 * (l_suppkey % 4)) end as impressoes",
        "_q * l_linenumber as clicks",
        "case when l_returnflag = 'A' then 0 else _q * 30 end as v3s",
        "_q * 25 as v2s",
        "_q * 10 as thruplay",
        "_q * 15 as p25",
        "_q * 2 as lpv",
        "_q % 40 as checkouts",
        "case l_suppkey % 4 when 0 then _q % 10 when 1 then _q % 20 when 2 then _q % 30 else 0 end as vendas",
        "l_suppkey % 3 as _bumps",
        "l_linestatus = 'O' as _com_valor",
    )
    value = (
        "cast(case when _com_valor and vendas > 0 then cast(vendas as decimal(9,0)) * 37.90 "
        "+ 17.00 * cast(_bumps as decimal(1,0)) else 0 end "
        "as decimal(12,2)) as valor"
    )
    return flat.selectExpr("* except (_bumps, _com_valor)", value)


def nested_insights(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as nested export records: text scalars and action arrays."""

    def action(kind: str, value) -> Column:
        return F.struct(F.lit(kind).alias("action_type"), value.cast("string").alias("value"))

    c = F.col
    actions = F.array(
        action("purchase", c("vendas")),
        action("omni_purchase", c("vendas")),
        action("offsite_conversion.fb_pixel_purchase", F.greatest(c("vendas") - 1, F.lit(0))),
        action("initiate_checkout", c("checkouts")),
        action("omni_initiated_checkout", c("checkouts") + 1),
        action("landing_page_view", c("lpv")),
        action("video_view", c("v3s")),
        action("other", F.lit("abc")),
    )

    def plays(name: str) -> Column:
        return F.array(action("video_view", c(name)))

    return insights(spark, folder).select(
        c("data").cast("string").alias("date_start"),
        c("hora_texto").alias("hourly_stats_aggregated_by_advertiser_time_zone"),
        "ad_id",
        "ad_name",
        "campaign_id",
        "campaign_name",
        c("gasto").cast("string").alias("spend"),
        c("impressoes").cast("string").alias("impressions"),
        c("clicks").cast("string").alias("clicks"),
        actions.alias("actions"),
        F.array(action("purchase", c("valor")), action("other", F.lit("9999"))).alias("action_values"),
        plays("thruplay").alias("video_thruplay_watched_actions"),
        plays("v2s").alias("video_continuous_2_sec_watched_actions"),
        F.lit(None).cast("array<struct<action_type:string,value:string>>").alias(
            "video_3_sec_watched_actions"
        ),
        plays("p25").alias("video_p25_watched_actions"),
    )


def loaded_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Insight rows the daily load takes, under canonical names."""
    kept = kept_rows(rows, CAMPAIGN_TEXT, EXCLUDED_CAMPAIGNS, EXCLUDED_ADS, daily_window(AD_DAY))
    return with_canonical_name(kept, aliases(spark))


def ad_daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily_facts(loaded_rows(spark, insights(spark, folder)))


def ad_hourly(spark: SparkSession, folder: str) -> DataFrame:
    rows = kept_rows(insights(spark, folder), CAMPAIGN_TEXT, period=hourly_window(AD_DAY))
    return hourly_facts(rows)


def sheet_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rows of the older generation: whole history, own names, keys may repeat."""
    kept = kept_rows(insights(spark, folder), CAMPAIGN_TEXT, EXCLUDED_CAMPAIGNS, EXCLUDED_ADS)
    return with_canonical_name(kept, None)


def creatives(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    return _with_ad(spark, folder, suppliers, "s_suppkey").selectExpr(
        "case when s_suppkey % 11 = 10 then cast(s_suppkey as string) else s_name end as anuncio",
        "cast(s_suppkey as string) as ad_id",
        f"{_CAMPAIGN} as campanha",
        "case s_suppkey % 6 when 0 then null when 1 then 'ativo' when 2 then 'testado' "
        "when 3 then ' Rodando ' when 4 then 'Descartado' else '' end as status",
        "r_name as formato",
        "case s_suppkey % 3 when 0 then 'E1' when 1 then 'E2' else '' end as estrutura",
        "n_name as angulo",
        "case when s_suppkey % 2 = 0 then 'Short one. Then more' "
        "else 'A long opening line without any punctuation mark that must be cut' end as hook",
        "case s_suppkey % 5 when 0 then null else concat('em', cast(s_suppkey % 5 as string)) end as emocao",
        "concat('am', cast(s_suppkey % 4 as string)) as amplificador",
        "concat('ar', cast(s_suppkey % 6 as string)) as arquetipo",
        "concat('sg', cast(s_suppkey % 2 as string)) as segmentacao",
        "case when s_suppkey % 9 = 0 then null else 'p' end as prova",
        "case when s_suppkey % 10 = 3 then 2 else 0 end as vendas_ajuste",
        "case when s_suppkey % 10 = 3 then cast(75.80 as decimal(12,2)) "
        "else cast(0 as decimal(12,2)) end as valor_ajuste",
        "cast(null as timestamp_ntz) as atualizado",
    )


def costs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "case when o_orderkey % 101 = 0 then '  ' else o_orderpriority end as nome",
        "case when o_orderkey % 97 = 0 then -cast(o_totalprice as decimal(12,2)) "
        "else cast(o_totalprice as decimal(12,2)) end as valor",
        "cast(o_orderdate as date) as data",
    )
