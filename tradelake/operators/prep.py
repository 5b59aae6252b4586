"""Preparation steps of the archive simulator, re-aimed as Spark operators: wide monthly price
table to long form, per-issuer activity profile, business-day calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_prices(wide: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Reader of a wide table (date + one numeric column per issuer): (date, issuer_name, price)."""
    issuers = [c for c in wide.columns if c != date_col]
    return wide.select(date_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in issuers]).unpivot(
        date_col, issuers, "issuer_name", "price"
    )


def monthly_prices(facts: DataFrame, instruments: DataFrame, issuers: DataFrame) -> DataFrame:
    """(month end, issuer_name, mean daily price), straight in long form; a month in which an issuer
    has no price has no row."""
    f = facts.select("instrument_id", "trade_date", "price_avg_weighted")
    i = instruments.select("instrument_id", "issuer_id").join(issuers.select("issuer_id", "issuer_name"), "issuer_id")
    p = F.col("price_avg_weighted")
    return (
        f.join(i, "instrument_id")
        .groupBy(F.last_day("trade_date").alias("trade_date"), "issuer_name")
        .agg(F.try_divide(F.sum(p).cast("double"), F.count(p).cast("double")).alias("price"))
    )


def positive_prices(long: DataFrame) -> DataFrame:
    """NULL and non-positive prices are dropped."""
    return long.where(F.col("price") > 0)


def activity_profile(long: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Per issuer: share of all periods with a positive value (missing, NULL and non-numeric count
    as 0) and the median of the positive values (0 when there are none)."""
    periods = long.agg(F.count_distinct(date_col).alias("n")).scalar()
    pos = F.col("price") > 0
    return long.groupBy("issuer_name").agg(
        (F.sum(F.when(pos, 1).otherwise(0)).cast("double") / F.first(periods).cast("double")).alias("nonzero_ratio"),
        F.coalesce(F.percentile(F.when(pos, F.col("price")), 0.5), F.lit(0.0)).alias("price_median"),
    )


def business_days(months: DataFrame, month_col: str = "month_start") -> DataFrame:
    """Monday-Friday dates from the first to the last day of each month."""
    start = F.trunc(F.col(month_col), "month")
    end = F.last_day(F.col(month_col))
    days = months.select(start.alias("month_start"), F.explode(F.sequence(start, end)).alias("trade_date"))
    return days.where(F.dayofweek("trade_date").between(2, 6))
