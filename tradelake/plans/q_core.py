"""Registered queries: daily facts, metrics, drawdown, summary, baselines, anomalies."""

from __future__ import annotations

from ..functions.columns import round_half_up
from ..operators import anomalies as A
from ..operators import metrics as M
from ..schemas import FACT_VALUE_COLUMNS
from . import oracle_sql as S
from .registry import out, register, wh

FACT_OUT = ["ticker", "trade_date", *FACT_VALUE_COLUMNS, "file_key"]
FACT_DEC = [
    "price_min",
    "price_avg_weighted",
    "price_aux",
    "yield_min_pct",
    "yield_max_pct",
    "yield_avg_pct",
    "turnover_value",
    "turnover_qty",
]
FACT_SQL = ", ".join(
    ["ticker", "trade_date"]
    + [f"CAST({c} AS DOUBLE) AS {c}" if c in FACT_DEC else c for c in FACT_VALUE_COLUMNS]
    + ["file_key"]
)

METRIC_OUT = [
    "ticker",
    "issuer_name",
    "currency_code",
    "instrument_type",
    "trade_date",
    *FACT_VALUE_COLUMNS,
    "file_key",
    "prev_price_avg_weighted",
    "price_change_abs",
    "daily_return_pct",
    "is_active_day",
    "intraday_range_pct",
]
METRIC_SQL = ", ".join(
    ["ticker", "issuer_name", "currency_code", "instrument_type", "trade_date"]
    + [f"CAST({c} AS DOUBLE) AS {c}" if c in FACT_DEC else c for c in FACT_VALUE_COLUMNS]
    + [
        "file_key",
        "CAST(prev_price_avg_weighted AS DOUBLE) AS prev_price_avg_weighted",
        "price_change_abs",
        "daily_return_pct",
        "is_active_day",
        "intraday_range_pct",
    ]
)

SUMMARY_OUT = [
    "ticker",
    "issuer_name",
    "currency_code",
    "instrument_type",
    "first_trade_date",
    "last_trade_date",
    "first_price",
    "last_price",
    "return_pct_all_period",
    "avg_turnover_value",
    "avg_deals_count",
    "active_days_count",
    "total_days_count",
    "active_days_share_pct",
    "volatility_pct",
    "max_drawdown_pct",
    "last_active_trade_date",
]


def summary_out(df):
    """Summary columns; the sample deviation is rounded to 4 places (its summation order is
    engine-specific, all other values are exact)."""
    return out(df.withColumn("volatility_pct", round_half_up("volatility_pct", 4)), *SUMMARY_OUT)


SUMMARY_SQL = (
    "ticker, issuer_name, currency_code, instrument_type, first_trade_date, last_trade_date, "
    "CAST(first_price AS DOUBLE) AS first_price, CAST(last_price AS DOUBLE) AS last_price, "
    "return_pct_all_period, avg_turnover_value, avg_deals_count, active_days_count, total_days_count, "
    f"active_days_share_pct, {S.rnd('volatility_pct', 4)} AS volatility_pct, max_drawdown_pct, "
    "last_active_trade_date"
)

ANOMALY_OUT = [c for c in A.ANOMALY_COLUMNS if c != "instrument_id"]
ANOMALY_SQL = (
    "ticker, issuer_name, trade_date, anomaly_type, anomaly_value_pct, "
    "CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, "
    "CAST(turnover_value AS DOUBLE) AS turnover_value, deals_count"
)


@register("daily_stats", S.base() + f"SELECT {FACT_SQL} FROM facts")
def q_daily_stats(spark, sf_dir):
    return out(wh(spark, sf_dir).facts, *FACT_OUT)


@register("daily_metrics", S.base() + f"SELECT {METRIC_SQL} FROM metrics")
def q_daily_metrics(spark, sf_dir):
    return out(wh(spark, sf_dir).metrics, *METRIC_OUT)


@register(
    "drawdown",
    S.base(S.drawdown_cte("metrics", "dd"))
    + "SELECT ticker, trade_date, CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, "
    "CAST(running_peak_price AS DOUBLE) AS running_peak_price, drawdown_pct FROM dd",
)
def q_drawdown(spark, sf_dir):
    d = M.with_drawdown(wh(spark, sf_dir).metrics)
    return out(d, "ticker", "trade_date", "price_avg_weighted", "running_peak_price", "drawdown_pct")


@register(
    "first_last_price",
    S.base()
    + "SELECT ticker, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, "
    f"CAST({S.first_value('price_avg_weighted')} AS DOUBLE) AS first_price, "
    f"CAST({S.last_value('price_avg_weighted')} AS DOUBLE) AS last_price FROM metrics GROUP BY ticker",
)
def q_first_last_price(spark, sf_dir):
    d = M.first_last_price(wh(spark, sf_dir).metrics)
    return out(d, "ticker", "first_trade_date", "last_trade_date", "first_price", "last_price")


@register("instrument_summary", S.base(S.summary_cte()) + f"SELECT {SUMMARY_SQL} FROM summary")
def q_instrument_summary(spark, sf_dir):
    return summary_out(wh(spark, sf_dir).summary)


@register(
    "trailing_baseline",
    S.base(S.anomalies_cte())
    + "SELECT ticker, trade_date, avg_turnover_prev20, avg_deals_prev20, "
    f"{S.rnd('std_return_prev20', 4)} AS std_return_prev20 FROM anomalies_m",
)
def q_trailing_baseline(spark, sf_dir):
    b = A.trailing_baseline(wh(spark, sf_dir).metrics)
    b = b.withColumn("std_return_prev20", round_half_up("std_return_prev20", 4))
    return out(b, "ticker", "trade_date", "avg_turnover_prev20", "avg_deals_prev20", "std_return_prev20")


@register("anomalies", S.base(S.anomalies_cte()) + f"SELECT {ANOMALY_SQL} FROM anomalies")
def q_anomalies(spark, sf_dir):
    return out(wh(spark, sf_dir).anomalies, *ANOMALY_OUT)


def flagship(spark, sf_dir):
    """The entry query: market anomalies over the whole history."""
    return q_anomalies(spark, sf_dir)
