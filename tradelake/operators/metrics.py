"""Daily metrics, drawdown and the per-instrument summary.

Windows are partitioned by ``(instrument_id, ticker)``: one instrument's history is bounded by
the number of trading days, and with the ticker in the partition spec Catalyst pushes a ticker
filter below the window (a date filter must *not* go below the LAG, and is never pushed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean_of, pct_change, share_pct
from ..schemas import DEFAULT_MARKET_SEGMENT

KEY = ["instrument_id", "ticker"]


def by_instrument(keys: list[str] | None = None):
    return Window.partitionBy(*(keys or KEY)).orderBy("trade_date")


# --- M1 ---------------------------------------------------------------------------------------
def enrich(facts: DataFrame, instruments: DataFrame, issuers: DataFrame) -> DataFrame:
    """Facts with instrument and issuer descriptors (inner joins; AQE broadcasts small sides)."""
    ins = instruments.select("instrument_id", "issuer_id", "currency_code", "instrument_type")
    iss = issuers.select("issuer_id", "issuer_name")
    return (
        facts.join(ins, "instrument_id")
        .join(iss, "issuer_id")
        .withColumn("market_segment", F.coalesce("market_segment", F.lit(DEFAULT_MARKET_SEGMENT)))
    )


def is_active() -> Column:
    """A day with any turnover or deals."""
    return (F.coalesce("turnover_value", F.lit(0)) > 0) | (F.coalesce("deals_count", F.lit(0)) > 0)


# --- M2-M6 ------------------------------------------------------------------------------------
def add_daily_metrics(enriched: DataFrame) -> DataFrame:
    """LAG over the full history, change, return, activity flag, intraday range."""
    p = F.col("price_avg_weighted")
    prev = F.lag(p).over(by_instrument())  # does not skip NULL prices
    return (
        enriched.withColumn("prev_price_avg_weighted", prev)
        .withColumn("price_change_abs", (p - F.col("prev_price_avg_weighted")).cast("double"))
        .withColumn("daily_return_pct", pct_change(p, "prev_price_avg_weighted"))
        .withColumn("is_active_day", is_active())
        .withColumn("intraday_range_pct", pct_change("price_aux", "price_min"))
    )


def described(facts: DataFrame) -> DataFrame:
    """Facts that carry their descriptors already (``normalize.described_facts``)."""
    return facts.withColumn("market_segment", F.coalesce("market_segment", F.lit(DEFAULT_MARKET_SEGMENT)))


def daily_metrics(facts: DataFrame, instruments: DataFrame, issuers: DataFrame) -> DataFrame:
    return add_daily_metrics(enrich(facts, instruments, issuers))


# --- M7-M8 ------------------------------------------------------------------------------------
def with_drawdown(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running peak of the price (unbounded preceding .. current row) and the drawdown in %."""
    w = by_instrument(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_peak_price", F.max("price_avg_weighted").over(w)).withColumn(
        "drawdown_pct", pct_change("price_avg_weighted", "running_peak_price")
    )


# --- M9-M10 -----------------------------------------------------------------------------------
def first_last_price(metrics: DataFrame) -> DataFrame:
    """Price on the first and on the last row of each instrument (may be NULL)."""
    return metrics.groupBy(*KEY).agg(
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"),
        F.min_by("price_avg_weighted", "trade_date").alias("first_price"),
        F.max_by("price_avg_weighted", "trade_date").alias("last_price"),
    )


def instrument_summary(metrics: DataFrame) -> DataFrame:
    """One row per instrument with facts: bounds, first/last price, return, averages, activity,
    volatility, maximum drawdown and last active date.  ``min_by``/``max_by`` replace the two
    ROW_NUMBER windows; the running peak shares the LAG's sort."""
    d = with_drawdown(metrics)
    active = F.col("is_active_day")
    agg = d.groupBy(
        "instrument_id", "ticker", "issuer_id", "issuer_name", "currency_code", "instrument_type"
    ).agg(
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"),
        F.min_by("price_avg_weighted", "trade_date").alias("first_price"),
        F.max_by("price_avg_weighted", "trade_date").alias("last_price"),
        mean_of("turnover_value").alias("avg_turnover_value"),
        mean_of("deals_count").alias("avg_deals_count"),
        F.sum(F.when(active, 1).otherwise(0)).cast("long").alias("active_days_count"),
        F.count(F.lit(1)).alias("total_days_count"),
        F.stddev_samp("daily_return_pct").alias("volatility_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        F.max(F.when(active, F.col("trade_date"))).alias("last_active_trade_date"),
    )
    return summary_columns(agg)


def summary_columns(agg: DataFrame) -> DataFrame:
    return agg.select(
        "instrument_id",
        "ticker",
        "issuer_id",
        "issuer_name",
        "currency_code",
        "instrument_type",
        "first_trade_date",
        "last_trade_date",
        "first_price",
        "last_price",
        pct_change("last_price", "first_price").alias("return_pct_all_period"),
        "avg_turnover_value",
        "avg_deals_count",
        "active_days_count",
        "total_days_count",
        share_pct("active_days_count", "total_days_count").alias("active_days_share_pct"),
        "volatility_pct",
        "max_drawdown_pct",
        "last_active_trade_date",
    )


# --- M11 --------------------------------------------------------------------------------------
def save_summary(summary: DataFrame, table_or_path: str, as_table: bool = False) -> None:
    """Materialise the summary (stale until refreshed, like a materialised view)."""
    writer = summary.write.mode("overwrite")
    if as_table:
        writer.saveAsTable(table_or_path)
    else:
        writer.parquet(table_or_path)


def refresh_summary(spark, metrics: DataFrame, table: str) -> bool:
    """Refresh the saved summary table if it exists; otherwise an informational no-op."""
    if not spark.catalog.tableExists(table):
        return False
    save_summary(instrument_summary(metrics), table, as_table=True)
    return True
