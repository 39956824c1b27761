"""The same queries as SQL for DuckDB, over the raw driver tables.

Written apart from the operators: no text is shared with them, so that an
error in one shows as a difference. ``_PARTS`` holds named sub-queries;
``_sql`` puts those a query needs, and those they need, in front of it.
"""

from __future__ import annotations

import re

_PARTS: dict[str, str] = {}


def _sql(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(_PARTS[name])
                needed.append(name)

    visit(body)
    head = ",\n".join(f"{name} as ({_PARTS[name].strip()})" for name in needed)
    return f"with {head}\n{body.strip()}" if head else body.strip()


_PARTS["paginas"] = """
select * from (values ('v2', 'brasil', 'meta'), ('tiktok', 'brasil', 'tiktok'),
  ('espanhol', 'latam', 'meta')) as t(codigo, funil, fonte)"""

_PARTS["eventos"] = """
select event_id as id, ts,
  concat('sess-', cast(user_id as varchar), '-', cast(cast(ts as date) as varchar)) as sessao,
  case when event_type = 'error' then 'respostas' else 'etapa' end as tipo,
  1 + case when k between 10 and 13 then 10 when k between 20 and 23 then 20 else k end as etapa,
  case user_id % 4 when 3 then null else concat('v', cast(user_id % 4 as varchar)) end as variante,
  case user_id % 5 when 0 then 'v2' when 1 then 'tiktok' when 2 then 'espanhol'
    when 3 then null else 'zz' end as pagina,
  case when event_type = 'error' then props end as dados,
  cast((ts at time zone 'UTC') at time zone 'America/Sao_Paulo' as date) as dia,
  event_type, user_id
from (select *, cast(json_extract_string(props, '$.k') as int) % 35 as k from events)"""

_PARTS["pings"] = """
select e.*, coalesce(p.funil, 'brasil') as funil, coalesce(p.fonte, 'meta') as fonte
from eventos e left join paginas p on p.codigo = e.pagina
where e.tipo = 'etapa' and e.etapa is not null"""


def _sessions(where: str = "true") -> str:
    return f"""
select sessao, max(if(etapa <= 34, etapa, 0)) as maxi, max(if(etapa = 35, 1, 0)) as comprou
from pings where {where} group by sessao"""


def _steps(where: str = "true") -> str:
    return f"""
select n, (select count(*) from ({_sessions(where)}) s where s.maxi >= n) as sessoes
from (select cast(range as int) as n from range(1, 35))"""


def _summary(sessions: str) -> str:
    return f"""
select visitantes, compraram, fim,
  case when visitantes = 0 then 0.0::double
    else floor(fim::double / visitantes::double * 1000 + 0.5) / 10 end as pct_fim,
  case when visitantes = 0 then 0.0::double
    else floor(compraram::double / visitantes::double * 1000 + 0.5) / 10 end as pct_compra
from (select count(*) filter (where maxi >= 1) as visitantes,
        cast(coalesce(sum(comprou), 0) as bigint) as compraram,
        count(*) filter (where maxi >= 34) as fim
      from ({sessions}))"""


_IN_PERIOD = "dia between date '2024-01-05' and date '2024-01-20'"

_PARTS["curva"] = f"""
with passos as ({_steps()}),
base as (select greatest(max(sessoes), 1) as b from passos),
ret as (select n, sessoes, floor(sessoes::double / b::double * 1000 + 0.5) / 10 as ret from passos, base),
quedas as (
  select a.n, a.sessoes, a.ret,
    case when a.n = 1 then 0.0::double else floor((p.ret - a.ret) * 10 + 0.5) / 10 end as queda
  from ret a left join ret p on p.n = a.n - 1)
select n, concat('Tela ', cast(n as varchar)) as nome, sessoes as acessos, ret, queda,
  n between 3 and 29 and queda > 5 as alerta, n >= 30 as pitch
from quedas"""

_PARTS["planilha"] = """
select event_id as id,
  -- other spellings of a time are given by the UTC time they mean, to the second
  case when event_id % 50 = 3 then 'bad' when event_id % 50 in (15, 16, 18, 19, 20) then cast(date_trunc('second', ts) as varchar)
    when event_id % 50 = 17 then cast(date_trunc('second', ts) + interval 3 hour as varchar)
    else cast(ts as varchar) end as ts,
  case event_id % 50 when 0 then 'abc' when 5 then concat('  u', cast(user_id as varchar), '-abc ')
    when 6 then repeat('s', 65) else concat('sess-', cast(user_id as varchar)) end as sessao,
  case event_id % 50 when 1 then 'outro' when 7 then ''
    else case when event_type = 'error' then 'respostas' else 'etapa' end end as tipo,
  case event_id % 50 when 2 then 'x' when 4 then '12abc' when 8 then '41' when 9 then ''
    else if(event_id % 50 = 14 and event_type = 'error', '99999999999', cast(1 + event_id % 35 as varchar)) end as etapa,
  case when event_id % 50 = 10 then repeat('v', 30) when event_id % 50 = 11 then ''
    when event_type = 'error' and event_id % 3 = 1 then '{"k":1,"k":2}'
    when event_type = 'error' then props else concat('v', cast(user_id % 4 as varchar)) end as data,
  case event_id % 50 when 12 then '' when 13 then repeat('p', 25) else 'v2' end as pagina
from events"""

_PARTS["planilha_lida"] = """
select id, try_cast(ts as timestamp) as ts, trim(sessao) as sessao,
  trim(case when tipo = '' then 'etapa' else tipo end) as tipo,
  cast(if(length(regexp_extract(etapa, '^[0-9]+')) > 9, 2147483647, try_cast(regexp_extract(etapa, '^[0-9]+') as bigint)) as int) as etapa,
  nullif(trim(pagina), '') as pagina, nullif(trim(data), '') as extra
from planilha"""

_PARTS["planilha_limpa"] = """
select id, ts, sessao, tipo, etapa,
  case when tipo = 'etapa' then left(extra, 24) end as variante, pagina,
  case when tipo = 'respostas' and json_valid(extra) then extra end as dados,
  case when length(sessao) not between 4 and 64 then 'sessao'
    when tipo not in ('etapa', 'respostas') then 'tipo'
    when tipo = 'etapa' and (etapa is null or etapa not between 1 and 40) then 'etapa'
    when ts is null then 'ts' end as motivo,
  case when etapa not between 1 and 40 then 'etapa' when length(pagina) > 24 then 'pagina' end as motivo2
from planilha_lida"""

_PARTS["sessoes_planilha"] = """
select sessao, dia, cast(if(length(regexp_extract(etapa, '^[0-9]+')) > 9, 2147483647, try_cast(regexp_extract(etapa, '^[0-9]+') as bigint)) as int) as e
from (select *, cast((try_cast(ts as timestamp) at time zone 'UTC')
        at time zone 'America/Sao_Paulo' as date) as dia from planilha)"""


def _sheet_sessions(where: str = "true") -> str:
    return f"""
select sessao, coalesce(max(e) filter (where e between 1 and 34), 0) as maxi,
  coalesce(max(1) filter (where e = 35), 0) as comprou
from sessoes_planilha where {where} group by sessao"""


# fixed "today" 2024-01-30, a Tuesday
_PARTS["periodos"] = """
select preset, cast(de as date) as de, cast(ate as date) as ate, rotulo from (values
  ('hoje', '2024-01-30', '2024-01-30', 'Hoje'),
  ('ontem', '2024-01-29', '2024-01-29', 'Ontem'),
  ('7d', '2024-01-24', '2024-01-30', 'Últimos 7 dias'),
  ('14d', '2024-01-17', '2024-01-30', 'Últimos 14 dias'),
  ('28d', '2024-01-03', '2024-01-30', 'Últimos 28 dias'),
  ('30d', '2024-01-01', '2024-01-30', 'Últimos 30 dias'),
  ('semana', '2024-01-29', '2024-01-30', 'Esta semana'),
  ('semana_passada', '2024-01-22', '2024-01-28', 'Semana passada'),
  ('mes', '2024-01-01', '2024-01-30', 'Este mês'),
  ('mes_passado', '2023-12-01', '2023-12-31', 'Mês passado'),
  ('todos', null, null, 'Máximo (todos)')) as t(preset, de, ate, rotulo)"""

_IN_PRESET = "(p.de is null or e.dia >= p.de) and (p.ate is null or e.dia <= p.ate)"

# --- ads --------------------------------------------------------------------
_PARTS["anuncios"] = """
select s.*, n.n_name, r.r_name, r.r_regionkey,
  concat(case when r.r_regionkey = 4 then 'Outro/' else 'Quiz/' end, n.n_name) as campanha
from supplier s join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey"""

_PARTS["linhas0"] = """
select cast(l.l_shipdate as date) as data, l.l_orderkey % 24 as hora,
  l.l_orderkey % 500 = 499 as sem_hora, cast(l.l_suppkey as varchar) as ad_id,
  case when l.l_suppkey % 11 = 10 then null else a.s_name end as ad_name,
  cast(a.s_nationkey as varchar) as campaign_id, a.campanha as campaign_name,
  cast(cast(floor(l.l_extendedprice) as bigint) * 0.001 * (1 + l.l_suppkey % 7) as decimal(12,2)) as gasto,
  case when l.l_suppkey % 50 = 49 then 0
    else cast(l.l_quantity as bigint) * (60 + 20 * (l.l_suppkey % 4)) end as impressoes,
  cast(l.l_quantity as bigint) * l.l_linenumber as clicks,
  case when l.l_returnflag = 'A' then 0 else cast(l.l_quantity as bigint) * 30 end as v3s,
  cast(l.l_quantity as bigint) * 25 as v2s, cast(l.l_quantity as bigint) * 10 as thruplay,
  cast(l.l_quantity as bigint) * 15 as p25, cast(l.l_quantity as bigint) * 2 as lpv,
  cast(l.l_quantity as bigint) % 40 as checkouts,
  case l.l_suppkey % 4 when 0 then cast(l.l_quantity as bigint) % 10
    when 1 then cast(l.l_quantity as bigint) % 20
    when 2 then cast(l.l_quantity as bigint) % 30 else 0 end as vendas,
  l.l_suppkey % 3 as bumps, l.l_linestatus = 'O' as com_valor
from lineitem l join anuncios a on l.l_suppkey = a.s_suppkey"""

_PARTS["linhas"] = """
select *, cast(case when com_valor and vendas > 0 then vendas * 37.90 + 17.00 * bumps else 0 end
  as decimal(12,2)) as valor from linhas0"""

_PARTS["planilha_diaria"] = """
select *, coalesce(nullif(ad_name, ''), ad_id) as anuncio from linhas
where campaign_name like '%Quiz%' and campaign_id is distinct from '13' and ad_id is distinct from '17'"""

_PARTS["consolidar"] = """
select * from (values ('Supplier#000000001', 'Supplier#000000000'),
  ('Supplier#000000002', 'Supplier#000000000')) as t(de, para)"""

_PARTS["carga"] = """
select p.* exclude (anuncio), coalesce(c.para, p.anuncio) as anuncio, c.para is not null as absorvido
from planilha_diaria p left join consolidar c on p.anuncio = c.de
where p.data between date '2001-07-31' - 1095 and date '2001-07-31'"""

_COUNTS = "impressoes clicks v3s v2s thruplay p25 lpv checkouts vendas".split()
_COUNT_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COUNTS)
_MONEY_SUMS = "cast(sum(gasto) as decimal(18,2)) as gasto, cast(sum(valor) as decimal(18,2)) as valor"
_SHOW_DAY = "cast(data as varchar) as data"
_SHOW_MONEY = "cast(gasto as double) as gasto, cast(valor as double) as valor"

_PARTS["diario"] = f"""
select data, anuncio, min(ad_id) as ad_id, min(campaign_name) as campanha, {_MONEY_SUMS}, {_COUNT_SUMS}
from carga group by data, anuncio"""

_PARTS["horario0"] = f"""
select data, cast(hora as int) as hora, coalesce(nullif(ad_name, ''), '(sem nome)') as anuncio, *
  exclude (data, hora) from linhas where not sem_hora and campaign_name like '%Quiz%'"""


def _hourly(day: str) -> str:
    return f"""
select data, hora, anuncio, {_MONEY_SUMS}, cast(sum(checkouts) as bigint) as checkouts,
  cast(sum(vendas) as bigint) as vendas
from horario0 where data between date '{day}' - 6 and date '{day}' group by data, hora, anuncio"""


_PARTS["horario"] = _hourly("2001-07-31")
# hours as they are exported: without a campaign, so of all campaigns
_PARTS["hora_cheia"] = """
select data, cast(hora as int) as hora, coalesce(nullif(ad_name, ''), '(sem nome)') as anuncio, sum(gasto) as gasto,
  sum(valor) as valor, cast(sum(checkouts) as bigint) as checkouts, count(*) as linhas, cast(sum(vendas) as bigint) as vendas
from linhas where not sem_hora and data between date '2001-07-25' and date '2001-07-31' group by 1, 2, 3"""
_PARTS["horario_anterior"] = _hourly("2001-07-28")

_PARTS["rolagem"] = """
select anuncio, min(ad_id) as ad_id,
  coalesce(arg_max(campaign_name, concat(cast(data as varchar), campaign_name)) filter (where not absorvido),
    arg_max(campaign_name, concat(cast(data as varchar), campaign_name)), '') as campanha,
  cast(sum(impressoes) as bigint) as impressoes,
  bool_or(impressoes > 0 and data >= date '2001-07-30') as recente
from carga group by anuncio"""

_PARTS["criativos"] = """
select case when s_suppkey % 11 = 10 then cast(s_suppkey as varchar) else s_name end as anuncio,
  cast(s_suppkey as varchar) as ad_id, campanha,
  case s_suppkey % 6 when 0 then null when 1 then 'ativo' when 2 then 'testado'
    when 3 then ' Rodando ' when 4 then 'Descartado' else '' end as status,
  r_name as formato, case s_suppkey % 3 when 0 then 'E1' when 1 then 'E2' else '' end as estrutura,
  n_name as angulo,
  case when s_suppkey % 2 = 0 then 'Short one. Then more'
    else 'A long opening line without any punctuation mark that must be cut' end as hook,
  case s_suppkey % 5 when 0 then null else concat('em', cast(s_suppkey % 5 as varchar)) end as emocao,
  concat('am', cast(s_suppkey % 4 as varchar)) as amplificador,
  concat('ar', cast(s_suppkey % 6 as varchar)) as arquetipo,
  concat('sg', cast(s_suppkey % 2 as varchar)) as segmentacao,
  case when s_suppkey % 9 = 0 then null else 'p' end as prova,
  case when s_suppkey % 10 = 3 then 2 else 0 end as vendas_ajuste,
  case when s_suppkey % 10 = 3 then 75.80 else 0.00 end as valor_ajuste
from anuncios"""

_TAGS = "formato estrutura angulo hook emocao amplificador arquetipo segmentacao prova".split()
_LABELS = ", ".join(f"c.{x}" for x in ["anuncio", "campanha", "status", *_TAGS])


def _metrics(where: str = "true") -> str:
    plain = ("impressoes", "clicks", "thruplay", "p25", "lpv", "checkouts")
    zeros = ", ".join(f"cast(coalesce(sum(d.{x}), 0) as bigint) as {x}" for x in plain)
    return f"""
select {_LABELS}, cast(coalesce(sum(d.gasto), 0) as decimal(18,2)) as gasto, {zeros},
  cast(coalesce(sum(if(d.v3s > 0, d.v3s, d.v2s)), 0) as bigint) as v3s,
  cast(coalesce(sum(d.vendas), 0) + any_value(c.vendas_ajuste) as bigint) as vendas,
  cast(coalesce(sum(d.valor), 0) + any_value(c.valor_ajuste) as decimal(18,2)) as valor
from criativos c left join (select * from diario where {where}) d using (anuncio)
where c.anuncio not in (select de from consolidar)
group by {_LABELS}"""


def _sheet_metrics(where: str = "true", creatives: str = "criativos", daily: str = "planilha_diaria") -> str:
    plain = ("impressoes", "clicks", "thruplay", "p25", "lpv", "checkouts")
    zeros = ", ".join(f"coalesce(t.{x}, 0) as {x}" for x in plain)
    return f"""
select {_LABELS}, coalesce(t.gasto, 0::decimal(18,2)) as gasto, {zeros},
  coalesce(if(t.v3s > 0, t.v3s, t.v2s), 0) as v3s,
  if(t.anuncio is null, 0, t.vendas + c.vendas_ajuste) as vendas,
  cast(case when t.anuncio is null then 0 when t.valor > 0 then t.valor + c.valor_ajuste
    else t.vendas * 37.90 + c.valor_ajuste end as decimal(18,2)) as valor
from {creatives} c left join (
  select anuncio, {_MONEY_SUMS}, {_COUNT_SUMS} from {daily} where {where} group by anuncio
) t using (anuncio)"""


def _net(revenue: str, sales: str) -> str:
    bumps = f"floor(({revenue} - {sales} * 37.90)::decimal(18,2)::double / 17.0::double + 0.5)::bigint"
    return (
        f"(case when {sales} = 0 then 0::decimal(18,2) "
        f"else cast({sales} * 33.50 + greatest({bumps}, 0) * 14.48 as decimal(18,2)) end)"
    )


def _roi(revenue: str, sales: str, spend: str) -> str:
    return f"(100::double * cast({_net(revenue, sales)} - {spend} as double) / {spend}::double)"


def _report(metrics: str) -> str:
    labels = ", ".join(["anuncio", "campanha", "status", *_TAGS])
    return f"""
select {labels}, gasto, impressoes,
  case when impressoes <> 0 then floor(10000::double * clicks::double / impressoes::double + 0.5) / 100 end as ctr_pct,
  case when impressoes <> 0 and v3s <> 0
    then floor(100::double * v3s::double / impressoes::double * 10 + 0.5) / 10 end as hook_rate_pct,
  case when v3s <> 0 then floor(100::double * thruplay::double / v3s::double * 10 + 0.5) / 10 end as hold_rate_pct,
  case when impressoes <> 0 then floor(100::double * p25::double / impressoes::double * 10 + 0.5) / 10 end as views25_pct,
  lpv, case when lpv <> 0 then floor(gasto::double / lpv::double * 100 + 0.5) / 100 end as custo_lpv,
  checkouts, case when checkouts <> 0 then floor(gasto::double / checkouts::double * 100 + 0.5) / 100 end as custo_checkout,
  vendas, case when vendas <> 0 then floor(gasto::double / vendas::double * 100 + 0.5) / 100 end as custo_venda,
  valor as faturamento,
  case when gasto <> 0 then floor(100::double * valor::double / gasto::double + 0.5) / 100 end as roas,
  {_net("valor", "vendas")} as liquido,
  case when gasto <> 0 then floor({_roi("valor", "vendas", "gasto")} * 10 + 0.5) / 10 end as roi_pct
from ({metrics})"""


def _report_out(metrics: str) -> str:
    return f"""
select * replace (gasto::double as gasto, faturamento::double as faturamento, liquido::double as liquido),
  coalesce(gasto >= 100 and ctr_pct >= 5
    and gasto::double / nullif(impressoes::double * ctr_pct / 100, 0) <= 1.0, false) as diamante
from ({_report(metrics)})"""


_PARTS["relatorio"] = _report(_sheet_metrics())
_PARTS["relatorio_completo"] = _report_out(_sheet_metrics())

# the sheet generation's rows under canonical names, whole history
_PARTS["planilha_nomeada"] = """
select p.* exclude (anuncio), coalesce(c.para, p.anuncio) as anuncio, c.para is not null as absorvido
from planilha_diaria p left join consolidar c on p.anuncio = c.de"""
_PARTS["planilha_rolagem"] = """
select anuncio, min(ad_id) as ad_id,
  coalesce(arg_max(campaign_name, concat(cast(data as varchar), campaign_name)) filter (where not absorvido),
    arg_max(campaign_name, concat(cast(data as varchar), campaign_name)), '') as campanha
from planilha_nomeada group by anuncio having sum(impressoes) > 0"""

_PARTS["planilha_nova"] = f"""
select coalesce(c.anuncio, r.anuncio) as anuncio, coalesce(c.ad_id, r.ad_id) as ad_id,
  coalesce(c.campanha, r.campanha) as campanha, case when c.anuncio is null then 'rodando' else c.status end as status,
  {", ".join("c." + t for t in _TAGS)}, coalesce(c.vendas_ajuste, 0) as vendas_ajuste,
  coalesce(c.valor_ajuste, 0) as valor_ajuste, c.anuncio is null as nova
from criativos c full join planilha_rolagem r on c.anuncio = r.anuncio"""
_PARTS["relatorio_novo"] = _report(_sheet_metrics(creatives="planilha_nova", daily="planilha_nomeada"))

_GROUP_TAGS = [t for t in _TAGS if t != "hook"]


def _grouped(tags) -> str:
    return " union all ".join(
        f"""
select '{t}' as etiqueta, coalesce(nullif({t}, ''), '(sem etiqueta)') as grupo, count(*) as n,
  cast(sum(gasto) as decimal(18,2)) as gasto, cast(sum(checkouts) as bigint) as checkouts,
  cast(sum(vendas) as bigint) as vendas, cast(sum(faturamento) as decimal(18,2)) as faturamento,
  cast(sum(impressoes) as bigint) as impressoes,
  cast(sum(impressoes * cast(coalesce(ctr_pct, 0) as decimal(12,2))) as double) / 100 as cliques
from relatorio group by 1, 2"""
        for t in tags
    )


_PARTS["grupos"] = _grouped(_GROUP_TAGS)
_PARTS["celulas"] = f"""
select etiqueta, grupo, 'cpa' as metrica,
  case when vendas <> 0 then gasto::double / vendas::double end as bruto from grupos
union all select etiqueta, grupo, 'roas',
  case when gasto <> 0 then faturamento::double / gasto::double end from grupos
union all select etiqueta, grupo, 'roi',
  case when gasto <> 0 then {_roi("faturamento", "vendas", "gasto")} end from grupos
union all select etiqueta, grupo, 'faturamento', faturamento::double from grupos
union all select etiqueta, grupo, 'ctr',
  case when impressoes <> 0 then 100 * cliques / impressoes::double end from grupos
union all select etiqueta, grupo, 'cpc', case when cliques <> 0 then gasto::double / cliques end from grupos
union all select etiqueta, grupo, 'gasto', gasto::double from grupos"""

_PARTS["custos"] = """
select cast(o_orderkey as varchar) as id,
  case when o_orderkey % 101 = 0 then '  ' else o_orderpriority end as nome,
  cast(case when o_orderkey % 97 = 0 then -cast(o_totalprice as decimal(12,2))
    else cast(o_totalprice as decimal(12,2)) end as decimal(12,2)) as valor,
  cast(o_orderdate as date) as data, o_orderstatus, o_orderpriority
from orders"""

_EVENT_COLUMNS = "id, cast(ts as varchar) as ts, sessao, tipo, etapa, variante, pagina, dados"


def _metrics_out(metrics: str) -> str:
    return f"select * replace (gasto::double as gasto, valor::double as valor) from ({metrics})"


def _charts() -> str:
    charts = {"custo_venda": "asc", "custo_checkout": "asc", "hook_rate_pct": "desc", "hold_rate_pct": "desc"}
    return " union all ".join(
        f"""
select * from (select '{name}' as grafico,
    cast(row_number() over (order by {name} {way}, anuncio) as int) as posicao,
    anuncio, {name} as valor, diamante
  from relatorio_completo where {name} > 0) where posicao <= 8"""
        for name, way in charts.items()
    )


_KEPT_STATUS = """case when trim(lower(coalesce(c.status, ''))) in ('', 'ativo', 'rodando', 'testado')
    then if(r.recente, 'ativo', 'testado') else trim(lower(c.status)) end"""
_DAILY_OUT = f"""
select {_SHOW_DAY}, anuncio, ad_id, campanha, {_SHOW_MONEY}, {", ".join(_COUNTS)} from diario"""
_INGESTED = """
select id, cast(ts as varchar) as ts, concat('sess-', cast(user_id as varchar)) as sessao, tipo, etapa,
  case when tipo = 'etapa' then concat('v', case user_id % 4 when 3 then '0' else cast(user_id % 4 as varchar) end) end
    as variante,
  pagina, dados
from recebidos where not recusado"""

_HOURLY_COLUMNS = "data, hora, anuncio, gasto, valor, checkouts, vendas"

# pings that carry a stage or answers; one of 31 characters as its variant is refused
_PARTS["recebidos"] = """
select e.*, tipo = 'etapa' and id % 50 = 10 as recusado
from (select e.*, cast(json_extract_string(r.props, '$.k') as int) as k
  from eventos e join events r on r.event_id = e.id) e
where not (event_type = 'view' and k < 5)"""

# changes of costs: every seventh comes twice, every eleventh names no stored cost, every thirteenth update is an insert
_PARTS["mudancas"] = """
select concat(case when numero % 11 = 0 then 'x' else '' end, case when op = 'insert' then 'n' else '' end, id) as id,
  nome, case when op = 'update' then valor + 10 else valor end as valor, data,
  case when numero % 13 = 0 and op = 'update' then 'insert' else op end as op, numero % 7 = 0 as dupla,
  case when op = 'delete' then null when length(trim(nome)) not between 1 and 120 then 'nome'
    when case when op = 'update' then valor + 10 else valor end < 0 then 'valor' end as quebra
from (select c.*, cast(id as bigint) as numero, case when o_orderstatus = 'F' then 'delete' when o_orderstatus = 'P' then 'update'
        when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'insert' end as op from custos c)
where op is not null"""
_PARTS["decididas"] = """
select m.*, case when quebra is not null then quebra when dupla then 'repetida'
    when m.op = 'insert' and c.id is not null then 'existente'
    when m.op in ('update', 'delete') and c.id is null then 'ausente' end as motivo
from mudancas m left join custos c on c.id = m.id"""

_BODIES = {
    "funnel_summary": _summary(_sessions()),
    "funnel_steps": _steps(),
    "funnel_json": f"""
select concat('{{"visitantes":', visitantes, ',"compraram":', compraram, ',"fim":', fim, ',"etapas":[',
  (select string_agg(concat('{{"n":', n, ',"sessoes":', sessoes, '}}'), ',' order by n) from ({_steps()})),
  ']}}') as funil
from ({_summary(_sessions())})""",
    "funnel_retention": "select * from curva",
    "funnel_alerts": "select n, queda from curva where alerta",
    "funnel_biggest_drop": """
select coalesce(first(n order by queda desc, n) filter (where n between 3 and 29 and queda > 0), 0) as tela,
  coalesce(max(queda) filter (where n between 3 and 29 and queda > 0), 0) as queda,
  coalesce(string_agg(cast(n as varchar), ',' order by n) filter (where alerta), '') as alertas
from curva""",
    "funnel_local_period": _steps(_IN_PERIOD),
    "funnel_variant_filter": _steps("variante in ('v0', 'v2')"),
    "funnel_page_filter": _steps("funil = 'brasil' and fonte = 'meta'"),
    "funnel_latam_period": _summary(
        _sessions(f"{_IN_PERIOD} and variante in ('v0', 'v1') and funil = 'latam'")
    ),
    "funnel_sheet_mode": f"""
select n, (select count(*) from ({_sheet_sessions()}) s where s.maxi >= n) as sessoes
from (select cast(range as int) as n from range(1, 35))""",
    "funnel_sheet_period": _summary(_sheet_sessions(_IN_PERIOD)),
    "variants_available": """
select variante, count(distinct sessao) as sessoes, cast(min(dia) as varchar) as ini,
  cast(max(dia) as varchar) as fim
from pings where variante <> '' group by variante""",
    "variants_in_period": f"""
select variante, count(distinct sessao) as sessoes, cast(min(dia) as varchar) as ini,
  cast(max(dia) as varchar) as fim
from pings where variante <> '' and {_IN_PERIOD} and funil = 'brasil' and fonte = 'meta'
group by variante""",
    "period_presets": f"""
select p.preset, cast(p.de as varchar) as de, cast(p.ate as varchar) as ate, p.rotulo, count(e.id) as pings
from periodos p left join eventos e on {_IN_PRESET}
group by all""",
    "funnel_by_preset": f"""
select p.preset, cast(p.de as varchar) as de, cast(p.ate as varchar) as ate, p.rotulo, s.*
from periodos p join (
  select p.preset, count(*) filter (where maxi >= 1) as visitantes,
    cast(coalesce(sum(comprou), 0) as bigint) as compraram, count(*) filter (where maxi >= 34) as fim,
    case when visitantes = 0 then 0.0::double
      else floor(fim::double / visitantes::double * 1000 + 0.5) / 10 end as pct_fim,
    case when visitantes = 0 then 0.0::double
      else floor(compraram::double / visitantes::double * 1000 + 0.5) / 10 end as pct_compra
  from periodos p left join (
    select p.preset, e.sessao, max(if(etapa <= 34, etapa, 0)) as maxi, max(if(etapa = 35, 1, 0)) as comprou
    from periodos p join pings e on {_IN_PRESET} group by all
  ) x on x.preset = p.preset
  group by p.preset
) s using (preset)""".replace("p.rotulo, s.*", "p.rotulo, s.* exclude (preset)"),
    "events_clean": f"select {_EVENT_COLUMNS} from planilha_limpa where motivo is null",
    "event_rejects": """
select coalesce(motivo, 'ok') as motivo, count(*) as linhas from planilha_limpa group by 1""",
    "event_rejects_table_checks": """
select coalesce(motivo, motivo2, 'ok') as motivo, count(*) as linhas from planilha_limpa group by 1""",
    "event_table_checks": """
select case when tipo not in ('etapa', 'respostas') then 'tipo'
    when e not between 1 and 40 then 'etapa' when length(sessao) not between 4 and 64 then 'sessao'
    when tipo <> 'respostas' and length(data) > 24 then 'variante'
    when length(pagina) > 24 then 'pagina' else 'ok' end as motivo, count(*) as linhas
from (select *, cast(if(length(regexp_extract(etapa, '^[0-9]+')) > 9, 2147483647, try_cast(regexp_extract(etapa, '^[0-9]+') as bigint)) as int) as e from planilha)
group by 1""",
    "cost_rejects": """
select case when length(trim(nome)) not between 1 and 120 then 'nome' when valor < 0 then 'valor'
  else 'ok' end as motivo, count(*) as linhas
from custos group by 1""",
    "insights_actions": f"""
select ad_id, count(*) as linhas,
  {", ".join(f"cast(sum({c}{' + 1' if c == 'checkouts' else ''}) as bigint) as {c}" for c in _COUNTS)},
  cast(sum(gasto) as double) as gasto, cast(sum(valor) as double) as valor
from (
  select ad_id, gasto, impressoes, clicks, v2s, thruplay, p25,
    list_sum([try_cast(x.value as bigint) for x in acoes if x.action_type = 'video_view']) as v3s,
    list_sum([try_cast(x.value as bigint) for x in acoes if x.action_type = 'landing_page_view']) as lpv,
    list_max([try_cast(x.value as bigint) for x in acoes if x.action_type like '%initiate%checkout']) - 1 as checkouts,
    list_max([try_cast(x.value as bigint) for x in acoes if x.action_type like '%purchase']) as vendas, valor
  from (select *, [
      {{'action_type': 'purchase', 'value': cast(vendas as varchar)}},
      {{'action_type': 'omni_purchase', 'value': cast(vendas as varchar)}},
      {{'action_type': 'offsite_conversion.fb_pixel_purchase', 'value': cast(greatest(vendas - 1, 0) as varchar)}},
      {{'action_type': 'initiate_checkout', 'value': cast(checkouts as varchar)}},
      {{'action_type': 'omni_initiated_checkout', 'value': cast(checkouts + 1 as varchar)}},
      {{'action_type': 'landing_page_view', 'value': cast(lpv as varchar)}},
      {{'action_type': 'video_view', 'value': cast(v3s as varchar)}},
      {{'action_type': 'other', 'value': 'abc'}}] as acoes from linhas))
group by ad_id""".replace("like '%initiate%checkout'", "like '%initiate%checkout%'"),
    "insights_json": f"""
select {_SHOW_DAY}, anuncio, min(ad_id) as ad_id, min(campaign_name) as campanha,
  cast(sum(gasto) as double) as gasto, cast(sum(valor) as double) as valor,
  {", ".join(f"cast(sum({c}{' + 1' if c == 'checkouts' else ''}) as bigint) as {c}" for c in _COUNTS)}
from carga group by data, anuncio""",
    "ad_daily": _DAILY_OUT,
    "ad_daily_combined": _DAILY_OUT,
    "ad_hourly": f"select {_HOURLY_COLUMNS} from (select {_SHOW_DAY}, hora, anuncio, {_SHOW_MONEY}, checkouts, vendas from horario)",
    "ad_daily_repeats": f"""
select {_SHOW_DAY}, anuncio, count(*) as linhas from planilha_diaria group by data, anuncio having count(*) > 1""",
    "ad_rollup_status": f"""
select r.*, {_KEPT_STATUS} as status from rolagem r left join criativos c using (anuncio)
where r.impressoes > 0""",
    "creative_metrics": _metrics_out(_metrics()),
    "creative_metrics_period": _metrics_out(_metrics("data between date '2000-01-01' and date '2001-03-31'")),
    "creative_metrics_sheet_mode": _metrics_out(
        _sheet_metrics("data between date '2000-01-01' and date '2001-03-31'")
    ),
    "creative_report": "select * from relatorio_completo",
    "creative_report_period": _report_out(
        _sheet_metrics("data between date '2001-07-01' and date '2001-07-31'")
    ),
    "creative_report_database": _report_out(_metrics()),
    "creative_medals": f"""
select anuncio, gasto::double as gasto, vendas, valor::double as valor,
  case when gasto <> 0 then floor(valor::double / gasto::double * 100 + 0.5) / 100 end as roas,
  case pos when 1 then 'Diamante' when 2 then 'Ouro' when 3 then 'Prata' when 4 then 'Bronze' end as medalha,
  case pos when 1 then '💎' when 2 then '🥇' when 3 then '🥈' when 4 then '🥉' end as selo
from (select *, case when gasto <= 0 then null
    when vendas >= 30 and valor >= 1.50 * gasto then 1 when vendas >= 50 and valor >= 1.25 * gasto then 2
    when vendas >= 30 and valor >= 1.25 * gasto then 3 when vendas >= 15 and valor >= 1.25 * gasto then 4 end as pos
  from ({_metrics("data between date '2001-07-01' and date '2001-07-31'")}))""",
    "daily_series": f"""
select {_SHOW_DAY}, cast(sum(gasto) as double) as gasto,
  cast(sum(if(valor > 0, valor, vendas * 37.90)) as double) as faturamento,
  cast(sum(vendas) as bigint) as vendas, cast(sum(checkouts) as bigint) as checkouts
from diario where data between date '2000-01-01' and date '2001-03-31' group by data""",
    "hourly_series": """
select cast(h.range as int) as hora, cast(coalesce(sum(gasto), 0) as double) as gasto,
  cast(coalesce(sum(if(valor > 0, valor, vendas * 37.90)), 0) as double) as faturamento,
  cast(coalesce(sum(vendas), 0) as bigint) as vendas, cast(coalesce(sum(checkouts), 0) as bigint) as checkouts
from range(24) h left join horario on hora = h.range group by h.range""",
    "tag_report": f"""
select etiqueta, grupo, n, gasto::double as gasto, checkouts, vendas, faturamento::double as faturamento,
  case when checkouts <> 0 then gasto::double / checkouts::double end as custo_checkout,
  case when vendas <> 0 then gasto::double / vendas::double end as custo_venda,
  case when gasto <> 0 then faturamento::double / gasto::double end as roas,
  case when gasto <> 0 then {_roi("faturamento", "vendas", "gasto")} end as roi_pct
from grupos where etiqueta in ('formato', 'angulo', 'emocao')""",
    "tag_metric_matrix": """
select etiqueta, grupo, metrica, floor(bruto * 100 + 0.5) / 100 as valor from celulas where bruto > 0""",
    "tag_negative_roi": """
select etiqueta, grupo, bruto as roi_pct from celulas where metrica = 'roi' and bruto <= 0""",
    "kpi_totals": f"""
select criativos, gasto::double as gasto, checkouts, vendas, faturamento::double as faturamento,
  cast({_net("faturamento", "vendas")} as double) as liquido,
  case when gasto <> 0 then faturamento::double / gasto::double else 0 end as roas,
  case when gasto <> 0 then {_roi("faturamento", "vendas", "gasto")} else 0 end as roi_pct
from (select count(*) filter (where trim(anuncio) <> '') as criativos,
    cast(sum(gasto) as decimal(18,2)) as gasto, cast(sum(checkouts) as bigint) as checkouts,
    cast(sum(vendas) as bigint) as vendas, cast(sum(faturamento) as decimal(18,2)) as faturamento
  from relatorio)""",
    "top_creatives": _charts(),
    "costs_in_period": """
select count(*) as lancamentos, cast(coalesce(sum(valor), 0) as double) as total from custos
where length(trim(nome)) between 1 and 120 and valor >= 0
  and data between date '1997-01-01' and date '1997-12-31'""",
    "creative_upsert": f"""
select coalesce(c.anuncio, r.anuncio) as anuncio, coalesce(r.ad_id, c.ad_id) as ad_id,
  coalesce(r.campanha, c.campanha) as campanha,
  case when r.anuncio is null then c.status else {_KEPT_STATUS} end as status,
  {", ".join("c." + t for t in _TAGS)}, coalesce(c.vendas_ajuste, 0) as vendas_ajuste,
  cast(coalesce(c.valor_ajuste, 0) as double) as valor_ajuste,
  case when r.anuncio is not null then '2001-07-31 12:00:00' end as atualizado
from criativos c
full join (select * from rolagem where impressoes > 0) r on c.anuncio = r.anuncio""",
    "creative_upsert_sheet_mode": f"""
select coalesce(c.anuncio, r.anuncio) as anuncio, coalesce(c.ad_id, r.ad_id) as ad_id,
  coalesce(c.campanha, r.campanha) as campanha, case when c.anuncio is null then 'rodando' else c.status end as status,
  {", ".join("c." + t for t in _TAGS)}, coalesce(c.vendas_ajuste, 0) as vendas_ajuste,
  cast(coalesce(c.valor_ajuste, 0) as double) as valor_ajuste,
  case when r.anuncio is not null then '2001-07-31 12:00:00' end as atualizado
from criativos c full join planilha_rolagem r on c.anuncio = r.anuncio""",
    "creative_sheet_refresh": f"""
select p.ad_id, p.anuncio, p.campanha, p.status, {", ".join("p." + t for t in _TAGS)},
  case when r.impressoes > 0 then r.gasto::double end as gasto,
  case when r.impressoes > 0 then r.impressoes end as impressoes,
  case when r.impressoes > 0 then r.ctr_pct end as ctr_pct,
  case when r.impressoes > 0 then coalesce(r.hook_rate_pct, if(p.nova, null, 1.5)) when p.nova then null
    else 1.5::double end as hook_rate_pct,
  case when r.impressoes > 0 then r.hold_rate_pct end as hold_rate_pct,
  case when r.impressoes > 0 then r.views25_pct end as views25_pct,
  case when r.impressoes > 0 and r.lpv > 0 then r.lpv end as lpv,
  case when r.impressoes > 0 then r.custo_lpv end as custo_lpv,
  case when r.impressoes > 0 then r.checkouts end as checkouts,
  case when r.impressoes > 0 then r.custo_checkout end as custo_checkout,
  case when r.impressoes > 0 then r.vendas end as vendas,
  case when r.impressoes > 0 then r.custo_venda end as custo_venda,
  case when r.impressoes > 0 then r.faturamento::double end as faturamento,
  case when r.impressoes > 0 then r.roas end as roas,
  case when r.impressoes > 0 then r.roi_pct end as roi_pct,
  p.vendas_ajuste, p.valor_ajuste::double as valor_ajuste,
  case when r.impressoes > 0 then '2001-07-31 12:00:00' else 'antes' end as atualizado
from planilha_nova p join relatorio_novo r using (anuncio)""",
    "daily_rewrite": _DAILY_OUT,
    "hourly_replace": f"""
select cast(data as varchar) as data, hora, anuncio, {_SHOW_MONEY}, checkouts, vendas
from (select {_HOURLY_COLUMNS} from horario union all
  select {_HOURLY_COLUMNS} from horario_anterior where data < date '2001-07-25')""",
    "seed_insert": """
select anuncio, campanha, status, formato from criativos
union all
select anuncio, null, 'novo', null from (
  select distinct coalesce(c.para, n.anuncio) as anuncio
  from (select coalesce(nullif(ad_name, ''), ad_id) as anuncio from linhas) n
  left join consolidar c on n.anuncio = c.de)
where anuncio not in (select anuncio from criativos)""",
    "status_backfill": """
select anuncio, case when lower(trim(status)) = 'rodando' then 'ativo' else status end as status
from criativos""",
    "creative_sheet_layout": """
select ad_id, anuncio, campanha, status, formato, angulo, hook, emocao, estrutura,
  null::varchar as arquetipo, null::varchar as segmentacao, null::varchar as amplificador,
  null::varchar as prova, null::double as gasto, null::bigint as impressoes, null::double as ctr_pct,
  null::double as hook_rate_pct, null::double as hold_rate_pct, null::double as views25_pct,
  null::bigint as lpv, null::double as custo_lpv, null::bigint as checkouts,
  null::double as custo_checkout, null::bigint as vendas, null::double as custo_venda,
  null::double as faturamento, null::double as roas, null::double as roi_pct,
  null::int as vendas_ajuste, null::double as valor_ajuste, null::varchar as atualizado
from criativos where estrutura <> ''""",
    "cost_changes": """
select c.id, coalesce(u.nome, c.nome) as nome, cast(coalesce(u.valor, c.valor) as double) as valor,
  cast(coalesce(u.data, c.data) as varchar) as data
from custos c left join (select * from decididas where motivo is null and op <> 'insert') u on u.id = c.id
where u.op is distinct from 'delete'
union all
select id, nome, cast(valor as double), cast(data as varchar) from decididas where motivo is null and op = 'insert'""",
    "cost_change_rejects": """
select motivo, cast(sum(if(dupla, 2, 1)) as bigint) as mudancas from decididas where motivo is not null group by 1""",
    "load_job": f"""
select 'diario' as tabela, cast(data as varchar) as data, null::int as hora, anuncio, gasto::double as gasto,
  valor::double as valor, checkouts + linhas as checkouts, vendas, null::varchar as texto
from (select data, anuncio, sum(gasto) as gasto, sum(valor) as valor, cast(sum(checkouts) as bigint) as checkouts,
    count(*) as linhas, cast(sum(vendas) as bigint) as vendas from carga group by data, anuncio)
union all
select 'horario', cast(data as varchar), hora, anuncio, gasto::double, valor::double, checkouts + linhas, vendas, null
from hora_cheia
union all
select 'criativos', null, null, coalesce(c.anuncio, r.anuncio), null, null, null, null,
  case when r.anuncio is null then c.status else {_KEPT_STATUS} end
from criativos c full join (select * from rolagem where impressoes > 0) r on c.anuncio = r.anuncio
union all
select 'auditoria', null, null, null, null, null, null, null, concat_ws('|', 'true',
  (select count(*) from linhas where campaign_name like '%Quiz%'
    and data between date '2001-07-31' - 1095 and date '2001-07-31'),
  (select count(*) from diario), (select count(*) from rolagem where impressoes > 0), (select count(*) from hora_cheia))""",
    "load_incremental": """
select 'v1' as versao, (select count(distinct data) from diario) as dias_regravados, (select count(*) from diario) as dias_gravados,
  0::bigint as linhas_malformadas, 0::bigint as linhas_recusadas
union all select 'v2', 0, (select count(*) from diario), 0, 0
union all select 'v3',
  (select count(distinct data) from carga where ad_id <> '5' and data in (select data from carga where ad_id = '5')),
  (select count(*) from (select distinct data, anuncio from carga where ad_id <> '5')),
  (select count(*) from linhas where ad_id = '7'), (select count(*) from linhas where ad_id = '8')""",
    "hourly_snapshot": f"""
select 'depois' as leitura, cast(data as varchar) as data, hora, anuncio, {_SHOW_MONEY}, checkouts, vendas
from (select {_HOURLY_COLUMNS} from horario union all
  select {_HOURLY_COLUMNS} from horario_anterior where data < date '2001-07-25')
union all
select 'antes', cast(data as varchar), hora, anuncio, {_SHOW_MONEY}, checkouts, vendas from horario_anterior""",
    "hourly_key_rejects": f"""
select {_SHOW_DAY}, hora, anuncio, 2::bigint as linhas, 0 as dias_na_tabela from horario where hora % 6 = 0""",
    "load_summary": """
select true as ok,
  (select count(*) from linhas where campaign_name like '%Quiz%'
    and data between date '2001-07-31' - 1095 and date '2001-07-31') as linhas_meta,
  (select count(*) from diario) as dias_gravados,
  (select count(*) from rolagem where impressoes > 0) as criativos,
  (select count(*) from horario) as horas_gravadas,
  '2001-07-31' as ate, '2001-07-31 12:00:00' as quando""",
    "stream_ingest": _INGESTED,
    "stream_compacted_events": _INGESTED,
    "ingest_rejects": "select 'variante' as motivo, count(*) as linhas from recebidos where recusado having count(*) > 0",
    "stream_page_funnel": _summary("""
select concat('sess-', cast(user_id as varchar)) as s, max(if(etapa <= 34, etapa, 0)) as maxi,
  max(if(etapa = 35, 1, 0)) as comprou
from recebidos where not recusado and tipo = 'etapa' and pagina = 'tiktok' group by 1"""),
    "stream_compacted_funnel": _summary(_sessions()),
    "stream_state_store": _summary(_sessions()),
    "variants_sketch": f"""
select variante, true as perto, cast(min(dia) as varchar) as ini, cast(max(dia) as varchar) as fim
from pings where variante <> '' and {_IN_PERIOD} and funil = 'brasil' and fonte = 'meta'
group by variante""",
    "events_clean_period": f"""
select {_EVENT_COLUMNS} from planilha_limpa where motivo is null and
  cast((ts at time zone 'UTC') at time zone 'America/Sao_Paulo' as date) between date '2024-01-05' and date '2024-01-20'""",
    "stream_session_state": f"select sessao, maxi, comprou = 1 as comprou from ({_sessions()})",
    "stream_session_funnel": _summary(
        _sessions(f"{_IN_PERIOD} and variante in ('v0', 'v1') and funil = 'latam'")
    ),
    "backfill_report": """
select 'historico' as origem, count(*) filter (where motivo is null and motivo2 is null) as mantidas,
  count(*) filter (where motivo is not null or motivo2 is not null) as puladas, 1::bigint as lotes, count(*) as total
from planilha_limpa""",
    "backfill_resume": f"select {_EVENT_COLUMNS} from planilha_limpa where motivo is null and motivo2 is null",
}

_BODIES["funnel_presets_of_days"] = _BODIES["funnel_by_preset"]
_BODIES["creative_keyed_refresh"] = _BODIES["creative_upsert"]
_BODIES["cost_keyed_changes"] = _BODIES["cost_changes"]

ORACLE_SQL = {name: _sql(body) for name, body in _BODIES.items()}
