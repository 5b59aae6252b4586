"""Approximate percentiles from stored quantile sketches (the exact form is `screening.thresholds`).

A KLL sketch of a column is a small value whose rank error is bounded (K = 400: about 0.7 % of the
rows, two-sided about 1 %) however many rows it has seen, and sketches merge.  So one sketch for each month and
metric is enough to answer percentiles of any span of months without reading a row again.  Which
values a sketch keeps is drawn at random: results of two runs differ within the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TIER_HIGH_PCT, TIER_LOW_PCT

K = 400
RANK_ERROR = 0.02  # stated bound of the tests and queries, twice what K gives


def sketch_values(rows: DataFrame, metrics: list[str], *keys: str, k: int = K) -> DataFrame:
    """keys, metric, n, sketch: one sketch of the non-null values of every metric and key."""
    values = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), metrics, "metric", "v")
    return values.where("v is not null").groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, n, sketch: sketches that agree in keys and metric, merged."""
    return sketches.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, *shares: float) -> DataFrame:
    """A row for each sketch and share: the sketch's keys, metric, n, p, value."""
    keep = [c for c in sketches.columns if c != "sketch"]
    asked = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in shares]
    return sketches.select(*keep, F.explode(F.array(*asked)).alias("x")).select(*keep, "x.p", "x.value")


def month_sketches(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """month (yyyymm), metric, n, sketch of daily values; to be stored, a few rows for each month."""
    month = (F.year("trade_date") * 100 + F.month("trade_date")).alias("month")
    return sketch_values(metrics.select(month, *columns), columns, "month")


def period_quantiles(stored: DataFrame, first_month: int, last_month: int, *shares: float) -> DataFrame:
    """metric, n, p, value over a span of months, from stored month sketches alone."""
    return quantiles(merge_sketches(stored.where(F.col("month").between(first_month, last_month))), *shares)


def approx_thresholds(summary: DataFrame) -> DataFrame:
    """The tier thresholds within the sketch's rank error, in the columns of `screening.thresholds`; no
    value is shuffled."""
    names = {"avg_turnover_value": "turnover", "volatility_pct": "vol"}
    found = quantiles(sketch_values(summary, list(names)), TIER_LOW_PCT, TIER_HIGH_PCT)
    marks = {(m, p): f"{short}_p{round(100 * p)}" for m, short in names.items() for p in (TIER_LOW_PCT, TIER_HIGH_PCT)}
    return found.agg(*[F.max(F.when((F.col("metric") == m) & (F.col("p") == p), F.col("value"))).alias(c) for (m, p), c in marks.items()])


def rank_errors(rows: DataFrame, found: DataFrame) -> DataFrame:
    """metric, p, n, rank_error: how far the share of values below (or up to) each quantile of ``found`` is
    from p.  ``found``: a few rows."""
    metrics = [r["metric"] for r in found.select("metric").distinct().collect()]  # column names
    values = rows.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "v").where("v is not null")
    both = values.join(F.broadcast(found.select("metric", "p", "value")), "metric")
    share = both.groupBy("metric", "p").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("v") < F.col("value")).cast("int")).alias("below"),
        F.avg((F.col("v") <= F.col("value")).cast("int")).alias("upto"),
    )
    off = F.greatest(F.col("below") - F.col("p"), F.col("p") - F.col("upto"), F.lit(0.0))
    return share.select("metric", "p", "n", off.alias("rank_error"))
