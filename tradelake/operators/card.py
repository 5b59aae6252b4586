"""Instrument card: KPIs of a period, as-of changes, price / activity history, anomalies.

The reference computes the card for one ticker with an unpartitioned window; here the same
KPIs come from one grouped pass per instrument (``max_by`` picks the last row and the as-of
rows), so the card for one ticker and for all tickers is the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean_of, pct_change, share_pct
from .metrics import KEY, with_drawdown
from .screening import _d, period_days, period_rows

CARD_COLUMNS = [
    "ticker",
    "issuer_name",
    "currency_code",
    "instrument_type",
    "last_trade_date",
    "last_price",
    "change_day_pct",
    "change_30d_pct",
    "change_90d_pct",
    "avg_turnover_value",
    "avg_deals_count",
    "active_days_count",
    "period_trading_days",
    "active_days_share_pct",
    "volatility_pct",
    "max_drawdown_pct",
]


def _asof_price(days: int, date_to) -> F.Column:
    """Price on the latest row dated on or before ``date_to - days`` (calendar days)."""
    cutoff = F.date_sub(_d(date_to), days)
    return F.max_by("price_avg_weighted", F.when(F.col("trade_date") <= cutoff, F.col("trade_date")))


def _period_card_agg(metrics: DataFrame, date_from, date_to, tickers: list[str] | None) -> DataFrame:
    d = with_drawdown(period_rows(metrics, date_from, date_to, tickers))
    return d.groupBy(*KEY, "issuer_name", "currency_code", "instrument_type").agg(  # an instrument has one of each
        F.max("trade_date").alias("last_trade_date"),
        F.max_by("price_avg_weighted", "trade_date").alias("last_price"),
        F.max_by("prev_price_avg_weighted", "trade_date").alias("last_prev_price"),
        _asof_price(30, date_to).alias("price_30d"),
        _asof_price(90, date_to).alias("price_90d"),
        mean_of("turnover_value").alias("avg_turnover_value"),
        mean_of("deals_count").alias("avg_deals_count"),
        F.count(F.lit(1)).alias("active_days_count"),
        F.stddev_samp("daily_return_pct").alias("volatility_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
    )


def card_kpis(
    metrics: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    date_from,
    date_to,
    tickers: list[str] | None = None,
) -> DataFrame:
    """One KPI row per instrument of the dimension, or per entry of ``tickers`` (known or not); one
    without rows in the period still gets a row with NULL metrics and a count of 0."""
    days = period_days(calendar, date_from, date_to).scalar()
    agg = _period_card_agg(metrics, date_from, date_to, tickers)
    if tickers is None:
        ins = instruments.select("ticker")
    else:
        ins = instruments.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    count = F.coalesce(F.col("active_days_count"), F.lit(0)).cast("long")
    return ins.join(agg, "ticker", "left").select(
        "ticker",
        "issuer_name",
        "currency_code",
        "instrument_type",
        "last_trade_date",
        "last_price",
        pct_change("last_price", "last_prev_price").alias("change_day_pct"),
        pct_change("last_price", "price_30d").alias("change_30d_pct"),
        pct_change("last_price", "price_90d").alias("change_90d_pct"),
        "avg_turnover_value",
        "avg_deals_count",
        count.alias("active_days_count"),
        days.alias("period_trading_days"),
        share_pct(count, days).alias("active_days_share_pct"),
        "volatility_pct",
        "max_drawdown_pct",
    )


def card(metrics, calendar, instruments, ticker: str, date_from, date_to) -> DataFrame:
    return card_kpis(metrics, calendar, instruments, date_from, date_to, [ticker])


def asof_change(metrics: DataFrame, date_from, date_to, tickers: list[str] | None = None) -> DataFrame:
    """Last price of the period against the price 30 and 90 calendar days before ``date_to``."""
    agg = _period_card_agg(metrics, date_from, date_to, tickers)
    return agg.select(
        "ticker",
        "last_trade_date",
        "last_price",
        "price_30d",
        "price_90d",
        pct_change("last_price", "price_30d").alias("change_30d_pct"),
        pct_change("last_price", "price_90d").alias("change_90d_pct"),
    )


def asof_prices(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The last row of each ticker on or before each cut-off: ticker, cutoff, asof_date, price (both
    NULL before the ticker's first row; the row's price may be NULL itself).  ``cutoffs``: ticker, cutoff,
    any number of them.  Prices and cut-offs of a ticker are sorted together once and the last price row
    is carried forward; no row meets a range of others."""
    price = F.struct(F.col("trade_date").alias("asof_date"), F.col("price_avg_weighted").alias("price"))
    rows = metrics.select("ticker", F.col("trade_date").alias("at"), F.lit(0).alias("kind"), price.alias("row"))
    asked = cutoffs.select("ticker", F.col("cutoff").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    upto = Window.partitionBy("ticker").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(upto)).where("kind = 1")
    return carried.select("ticker", F.col("at").alias("cutoff"), "row.asof_date", "row.price")


def price_history(metrics: DataFrame, ticker: str, date_from, date_to) -> DataFrame:
    return (
        period_rows(metrics, date_from, date_to, [ticker])
        .select("trade_date", "price_avg_weighted")
        .orderBy("trade_date")
    )


def activity_history(metrics: DataFrame, ticker: str, date_from, date_to) -> DataFrame:
    return (
        period_rows(metrics, date_from, date_to, [ticker])
        .select("trade_date", "turnover_value", "deals_count")
        .orderBy("trade_date")
    )


def card_anomalies(anomalies: DataFrame, ticker: str, date_from, date_to, n: int = 20) -> DataFrame:
    """The ``n`` most recent anomalies of a ticker (date desc, type)."""
    return (
        anomalies.where(
            (F.col("ticker") == F.lit(ticker)) & F.col("trade_date").between(_d(date_from), _d(date_to))
        )
        .select("trade_date", "anomaly_type", "anomaly_value_pct", "price_avg_weighted", "turnover_value", "deals_count")
        .orderBy(F.col("trade_date").desc(), "anomaly_type")
        .limit(n)
    )
