"""Values the results depend on."""

from __future__ import annotations

from decimal import Decimal

# --- Fixed values: funnel geometry ---------------------------------------
SCREENS = 34            # screens 1..34
BUY_STAGE = 35          # the click on "buy", not a screen
MAX_STAGE = 40          # largest stage number a ping may carry
BODY_FIRST = 3          # monitored body: screens 3..29
BODY_LAST = 29
PITCH_FIRST = 30        # pitch starts here
DROP_ALERT = 5          # alert above this many percentage points

# --- Fixed values: time ---------------------------------------------------
LOCAL_ZONE = "America/Sao_Paulo"
DAILY_WINDOW_DAYS = 1095
HOURLY_WINDOW_DAYS = 7

# --- Fixed values: money --------------------------------------------------
LIST_PRICE = Decimal("37.90")
BUMP_PRICE = Decimal("17.00")
NET_SALE = Decimal("33.50")
NET_BUMP = Decimal("14.48")

# --- Fixed values: "diamond" highlight -----------------------------------
DIAMOND_MIN_CTR = 5
DIAMOND_MAX_CPC = 1.0
DIAMOND_MIN_SPEND = 100

# --- Fixed values: row limits --------------------------------------------
SESSION_LENGTH = (4, 64)
VARIANT_LENGTH = 24
PAGE_LENGTH = 24
COST_NAME_LENGTH = (1, 120)
EVENT_TYPES = ("etapa", "respostas")

# --- Fixed values: names --------------------------------------------------
DEFAULT_FUNNEL = "brasil"
DEFAULT_SOURCE = "meta"
NO_TAG = "(sem etiqueta)"
NO_NAME = "(sem nome)"
TAGS = (
    "formato", "estrutura", "angulo", "hook", "emocao",
    "amplificador", "arquetipo", "segmentacao", "prova",
)
GROUP_TAGS = (
    "formato", "estrutura", "angulo", "emocao",
    "amplificador", "arquetipo", "segmentacao", "prova",
)

# --- Fixed values: action types of the ad platform ------------------------
VIDEO_VIEW = "video_view"
LANDING_VIEW = "landing_page_view"
CHECKOUT_ACTIONS = (
    "initiate_checkout",
    "omni_initiated_checkout",
    "offsite_conversion.fb_pixel_initiate_checkout",
)
PURCHASE_ACTIONS = (
    "purchase",
    "omni_purchase",
    "offsite_conversion.fb_pixel_purchase",
)

# --- Fixed values: period presets and their labels ------------------------
PRESET_LABELS = {
    "hoje": "Hoje",
    "ontem": "Ontem",
    "7d": "Últimos 7 dias",
    "14d": "Últimos 14 dias",
    "28d": "Últimos 28 dias",
    "30d": "Últimos 30 dias",
    "semana": "Esta semana",
    "semana_passada": "Semana passada",
    "mes": "Este mês",
    "mes_passado": "Mês passado",
    "todos": "Máximo (todos)",
}

# --- Fixed values: seed rows ----------------------------------------------
PAGE_SEED = (
    ("v2", "brasil", "meta", "Quiz BR — Meta"),
    ("tiktok", "brasil", "tiktok", "Quiz BR — TikTok"),
    ("espanhol", "latam", "meta", "Quiz Latam — Meta"),
)
MEDAL_RULES = (
    {"selo": "💎", "nome": "Diamante", "vendas": 30, "roas": 1.50},
    {"selo": "🥇", "nome": "Ouro", "vendas": 50, "roas": 1.25},
    {"selo": "🥈", "nome": "Prata", "vendas": 30, "roas": 1.25},
    {"selo": "🥉", "nome": "Bronze", "vendas": 15, "roas": 1.25},
)
