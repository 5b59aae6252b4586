"""Trailing baselines and market anomalies (price jump, turnover spike, deals spike)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import JUMP_FLOOR_PCT, JUMP_STD_FACTOR, SPIKE_FACTOR, TRAILING_ROWS
from .metrics import KEY

ANOMALY_COLUMNS = [
    "instrument_id",
    "ticker",
    "issuer_name",
    "trade_date",
    "anomaly_type",
    "anomaly_value_pct",
    "price_avg_weighted",
    "turnover_value",
    "deals_count",
]


def _trailing_mean(c: str, w) -> Column:
    return F.try_divide(F.sum(c).over(w).cast("double"), F.count(c).over(w).cast("double"))


def trailing_baseline(metrics: DataFrame, n: int = TRAILING_ROWS) -> DataFrame:
    """Averages of turnover and deals and the sample deviation of returns over the previous
    ``n`` rows (not days), excluding the current row; the first row has no baseline."""
    w = Window.partitionBy(*KEY).orderBy("trade_date").rowsBetween(-n, -1)
    return (
        metrics.withColumn("avg_turnover_prev20", _trailing_mean("turnover_value", w))
        .withColumn("avg_deals_prev20", _trailing_mean("deals_count", w))
        .withColumn("std_return_prev20", F.stddev_samp("daily_return_pct").over(w))
    )


def _spike(value: str, avg: str, factor: float) -> tuple[Column, Column]:
    v, a = F.col(value), F.col(avg)
    cond = a.isNotNull() & (a > 0) & v.isNotNull() & (v.cast("double") >= a * F.lit(factor))
    return cond, (v.cast("double") / a - F.lit(1)) * F.lit(100)


def anomalies(
    metrics: DataFrame,
    n: int = TRAILING_ROWS,
    spike_factor: float = SPIKE_FACTOR,
    jump_std_factor: float = JUMP_STD_FACTOR,
    jump_floor_pct: float = JUMP_FLOOR_PCT,
) -> DataFrame:
    """0..3 anomaly rows per (instrument, date), in one pass over the trailing baseline.

    The three rule branches are built as an array of optional structs and exploded, so the
    windows are evaluated once instead of once per UNION branch.
    """
    base = trailing_baseline(metrics, n)
    r = F.col("daily_return_pct")
    jump = r.isNotNull() & (
        F.abs(r)
        >= F.greatest(F.lit(jump_floor_pct), F.lit(jump_std_factor) * F.coalesce("std_return_prev20", F.lit(0.0)))
    )
    t_cond, t_val = _spike("turnover_value", "avg_turnover_prev20", spike_factor)
    d_cond, d_val = _spike("deals_count", "avg_deals_prev20", spike_factor)

    def hit(cond: Column, kind: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("t"), value.cast("double").alias("v")))

    hits = F.filter(
        F.array(hit(jump, "price_jump", r), hit(t_cond, "turnover_spike", t_val), hit(d_cond, "deals_spike", d_val)),
        lambda x: x.isNotNull(),
    )
    return (
        base.select(
            "instrument_id",
            "ticker",
            "issuer_name",
            "trade_date",
            "price_avg_weighted",
            "turnover_value",
            "deals_count",
            F.explode(hits).alias("a"),
        )
        .select(
            *ANOMALY_COLUMNS[:4],
            F.col("a.t").alias("anomaly_type"),
            F.col("a.v").alias("anomaly_value_pct"),
            *ANOMALY_COLUMNS[6:],
        )
    )


# --- Q20-Q23: anomaly search page ---------------------------------------------------------------
def search_anomalies(
    anomalies_df: DataFrame,
    date_from,
    date_to,
    ticker: str | None = None,
    types: tuple[str, ...] | list[str] = ("price_jump", "turnover_spike", "deals_spike"),
    min_abs_pct: float = 0.0,
) -> DataFrame:
    """Inclusive period, optional ticker, type list, ``|value| >= min_abs_pct``; ordered by
    date desc, |value| desc, ticker."""
    a = anomalies_df.where(
        F.col("trade_date").between(F.lit(str(date_from)).cast("date"), F.lit(str(date_to)).cast("date"))
        & F.col("anomaly_type").isin(list(types))
        & (F.abs("anomaly_value_pct") >= F.lit(float(min_abs_pct)))
    )
    if ticker is not None:
        a = a.where(F.col("ticker") == F.lit(ticker))
    return a.select(
        "trade_date",
        "ticker",
        "issuer_name",
        "anomaly_type",
        "anomaly_value_pct",
        "price_avg_weighted",
        "turnover_value",
        "deals_count",
    ).orderBy(F.col("trade_date").desc(), F.abs("anomaly_value_pct").desc(), "ticker")


def anomaly_headline(found: DataFrame) -> DataFrame:
    """Count, distinct tickers and the largest |value| (0 when nothing was found)."""
    return found.agg(
        F.count(F.lit(1)).alias("anomalies_count"),
        F.countDistinct("ticker").alias("tickers_count"),
        F.coalesce(F.max(F.abs("anomaly_value_pct")), F.lit(0.0)).alias("max_abs_value_pct"),
    )


def anomalies_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))


def anomalies_by_ticker(found: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` tickers by anomaly count, ties by ticker."""
    return (
        found.groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "ticker")
        .limit(n)
    )
