"""Input and table schemas."""

EVENTS = (
    "id bigint, ts timestamp_ntz, sessao string, tipo string, etapa int, "
    "variante string, pagina string, dados string"
)
# text as it comes from the spreadsheet export
EVENT_SHEET = "id bigint, ts string, sessao string, tipo string, etapa string, data string, pagina string"
# parameters of one ping request
PING = (
    "id bigint, recebido timestamp_ntz, action string, sessao string, etapa string, "
    "v string, data string, pagina string"
)
PAGES = "codigo string, funil string, fonte string, rotulo string"
ALIASES = "anuncio string, canonico string"
CONFIG = "chave string, valor string"
MEDAL_RULES = "array<struct<selo:string,nome:string,vendas:int,roas:decimal(8,2)>>"
CREATIVES = (
    "anuncio string, ad_id string, campanha string, status string, formato string, "
    "estrutura string, angulo string, hook string, emocao string, amplificador string, "
    "arquetipo string, segmentacao string, prova string, vendas_ajuste int, "
    "valor_ajuste decimal(12,2), atualizado timestamp_ntz"
)
COSTS = "id string, nome string, valor decimal(12,2), data date"

_ACTIONS = "array<struct<action_type:string,value:string>>"
# one record of the ad-insights export, with every scalar as text
INSIGHTS = (
    "date_start string, hourly_stats_aggregated_by_advertiser_time_zone string, ad_id string, "
    "ad_name string, campaign_id string, campaign_name string, spend string, impressions string, "
    f"clicks string, actions {_ACTIONS}, action_values {_ACTIONS}, "
    f"video_thruplay_watched_actions {_ACTIONS}, video_continuous_2_sec_watched_actions {_ACTIONS}, "
    f"video_3_sec_watched_actions {_ACTIONS}, video_p25_watched_actions {_ACTIONS}"
)
# columns of the creative sheet, oldest layout first, with what later layouts added
CREATIVE_SHEET = (
    "ad_id string, anuncio string, campanha string, status string, formato string, angulo string, "
    "hook string, emocao string, estrutura string, arquetipo string, segmentacao string, "
    "amplificador string, prova string, gasto double, impressoes bigint, ctr_pct double, "
    "hook_rate_pct double, hold_rate_pct double, views25_pct double, lpv bigint, custo_lpv double, "
    "checkouts bigint, custo_checkout double, vendas bigint, custo_venda double, faturamento double, "
    "roas double, roi_pct double, vendas_ajuste int, valor_ajuste decimal(12,2), atualizado string"
)
