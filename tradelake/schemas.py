"""Table schemas, the archive header map and other fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# These must equal the archive format and the analytics definitions exactly.
# ---------------------------------------------------------------------------------------------

# Archive sheet name and header texts (column order of the export), mapped to raw columns.
# The sixth column's header is blank in real exports; it is taken by position.
ARCHIVE_SHEET = "MarketStockResult"
HEADER_MAP = {
    "Тикер": "ticker_raw",
    "Краткое наименование эмитента": "issuer_name_raw",
    "Валюта ценообразования": "currency_code_raw",
    "Цена, вал.обр. (мин.)": "price_min_raw",
    "Цена, вал.обр. (срвз.)": "price_avg_raw",
    "Доходность (мин., %)": "yield_min_raw",
    "Доходность (макс., %)": "yield_max_raw",
    "Доходность (срвз., %)": "yield_avg_raw",
    "Оборот (в вал.ценообр.)": "turnover_value_raw",
    "Оборот (в шт.)": "turnover_qty_raw",
    "Количество сделок": "deals_count_raw",
    "Срок": "term_days_raw",
    "Время сделки": "trade_datetime_raw",
}
POSITIONAL_COLUMNS = {5: "price_aux_raw"}

DEFAULT_MARKET_SEGMENT = "shares"
DEFAULT_CURRENCY = "BYN"
DEFAULT_INSTRUMENT_TYPE = "share"
INSTRUMENT_TYPES = ("share", "bond", "depositary_receipt", "other")
DEFAULT_SOURCE_TYPE = "archive_demo_xlsx"
LOAD_NOTE = "Loaded by tradelake batch load"

ANOMALY_TYPES = ("price_jump", "turnover_spike", "deals_spike")
# Anomaly thresholds: trailing window of 20 rows, spike factor 2.5, jump floor 1.5 %.
TRAILING_ROWS = 20
SPIKE_FACTOR = 2.5
JUMP_STD_FACTOR = 2.5
JUMP_FLOOR_PCT = 1.5

TIER_LOW_PCT = 0.33
TIER_HIGH_PCT = 0.67
TIER_LABELS = ("high", "medium", "low")
LIQUID_MIN_TURNOVER = 10000

# Raw numeric columns with their precision and scale, and the payload columns in archive order.
RAW_DECIMAL_COLUMNS = {
    "price_min_raw": (18, 6),
    "price_avg_raw": (18, 6),
    "price_aux_raw": (18, 6),
    "yield_min_raw": (12, 6),
    "yield_max_raw": (12, 6),
    "yield_avg_raw": (12, 6),
    "turnover_value_raw": (20, 2),
    "turnover_qty_raw": (20, 6),
}
RAW_INT_COLUMNS = ["deals_count_raw", "term_days_raw"]
RAW_COLUMNS = [
    "ticker_raw",
    "issuer_name_raw",
    "currency_code_raw",
    "price_min_raw",
    "price_avg_raw",
    "price_aux_raw",
    "yield_min_raw",
    "yield_max_raw",
    "yield_avg_raw",
    "turnover_value_raw",
    "turnover_qty_raw",
    "deals_count_raw",
    "term_days_raw",
    "trade_datetime_raw",
    "market_segment_raw",
]

# Value columns of the daily facts.
FACT_VALUE_COLUMNS = [
    "price_min",
    "price_avg_weighted",
    "price_aux",
    "yield_min_pct",
    "yield_max_pct",
    "yield_avg_pct",
    "turnover_value",
    "turnover_qty",
    "deals_count",
    "term_days",
    "market_segment",
]

# Archive file names end in year and month.
FILE_PERIOD = r"(\d{4})_(\d{2})"
# ---------------------------------------------------------------------------------------------


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


RAW_PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["ticker_raw", "issuer_name_raw", "currency_code_raw"]]
    + [T.StructField(c, _dec(*ps)) for c, ps in RAW_DECIMAL_COLUMNS.items()]
    + [T.StructField(c, T.IntegerType()) for c in RAW_INT_COLUMNS]
    + [
        T.StructField("trade_datetime_raw", T.TimestampNTZType()),
        T.StructField("market_segment_raw", T.StringType()),
    ]
)
