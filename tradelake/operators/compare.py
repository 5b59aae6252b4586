"""Multi-instrument comparison: period summary, history, rebased price index, correlation.

Both the index and the correlation work on an explicit ticker list (the comparison page
takes 2-5 tickers), so anything indexed by ticker is bounded by that list, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_half_up
from .screening import period_rows, period_stats

COMPARISON_COLUMNS = [
    "ticker",
    "issuer_name",
    "first_price",
    "last_price",
    "return_pct_period",
    "avg_turnover_value",
    "avg_deals_count",
    "active_days_count",
    "period_trading_days",
    "active_days_share_pct",
    "volatility_pct",
    "max_drawdown_pct",
]


def compare(metrics: DataFrame, calendar: DataFrame, tickers: list[str], date_from, date_to) -> DataFrame:
    """Q4 statistics for the chosen tickers, unrounded, with first price; ordered by ticker."""
    s = period_stats(metrics, calendar, date_from, date_to, tickers)
    return s.select(*COMPARISON_COLUMNS).orderBy("ticker")


def compare_history(metrics: DataFrame, tickers: list[str], date_from, date_to, ordered: bool = True) -> DataFrame:
    """Long-form history of the chosen tickers.  ``ordered=False`` skips the final sort for
    consumers that aggregate it (index, correlation): a global sort costs a range-partition
    sample, a shuffle and a sort, and Catalyst keeps it below averages of doubles."""
    rows = period_rows(metrics, date_from, date_to, tickers).select(
        "trade_date", "ticker", "price_avg_weighted", "daily_return_pct"
    )
    return rows.orderBy("trade_date", "ticker") if ordered else rows


def price_index(history: DataFrame, tickers: list[str]) -> DataFrame:
    """Prices rebased to 100 at each ticker's first non-NULL price, forward-filled along the
    union of the tickers' trading dates (long form: trade_date, ticker, price_index).

    Leading gaps stay NULL, a base of 0 makes the whole ticker NULL, dates where every ticker
    is NULL are dropped, tickers without any price do not appear.
    """
    listed = F.col("ticker").isin(list(tickers))  # so the base prices are a row for each of them at most
    h = history.where(F.col("price_avg_weighted").isNotNull() & listed).select(
        "trade_date", "ticker", F.col("price_avg_weighted").alias("p")
    )
    base = h.groupBy("ticker").agg(F.min_by("p", "trade_date").alias("base"), F.min("trade_date").alias("first_date"))
    dates = h.select("trade_date").distinct()
    grid = dates.select("trade_date", F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker"))
    grid = grid.join(F.broadcast(base.drop("first_date")), "ticker")  # base has at most len(tickers) rows
    filled = grid.join(h, ["trade_date", "ticker"], "left").withColumn(
        "pf",
        F.last("p", ignorenulls=True).over(
            Window.partitionBy("ticker").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    idx = filled.select(
        "trade_date",
        "ticker",
        F.when(F.col("base") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("pf").cast("double") / F.col("base").cast("double") * F.lit(100))
        .alias("price_index"),
    )
    # After the forward fill a ticker with a non-zero base has a value on every date from its
    # first price on, so a date is all-NULL exactly when it precedes the earliest such first
    # price: a scalar subquery instead of a second window (and shuffle) keyed by date.
    start = base.where(F.col("base") != 0).select(F.min("first_date")).scalar()
    return idx.where(F.col("trade_date") >= start).orderBy("trade_date", "ticker")


def price_index_wide(index_long: DataFrame, tickers: list[str]) -> DataFrame:
    """The chart layout: one row per date, one column per ticker."""
    v = F.col("price_index")
    return (
        index_long.groupBy("trade_date")
        .agg(*[F.max(F.when(F.col("ticker") == F.lit(t), v)).alias(t) for t in tickers])
        .orderBy("trade_date")
    )


def correlation(history: DataFrame, tickers: list[str], digits: int = 3) -> DataFrame:
    """Pearson correlation of daily returns over pairwise-complete dates (long form).

    Returns are pivoted to one column per ticker (one row per date), then every pair's
    co-moments come out of a single global aggregation; no pairs of rows are generated.
    ``covar_samp / (stddev_samp * stddev_samp)`` instead of ``corr``: a zero variance or a single
    shared date gives NULL rather than an error.  Tickers without any return vanish; fewer than
    two remaining tickers give an empty result.
    """
    tickers = list(dict.fromkeys(tickers))
    # Pivot as conditional aggregates (one hash aggregation, no PivotFirst): mean per
    # (date, ticker), like pandas pivot_table; a fact key is unique, so it is the value itself.
    r = F.col("daily_return_pct")
    wide = (
        history.where(F.col("ticker").isin(tickers))
        .groupBy("trade_date")
        .agg(*[F.avg(F.when(F.col("ticker") == F.lit(t), r)).alias(t) for t in tickers])
    )
    c = {t: F.col(f"`{t}`") for t in tickers}
    aggs: list[Column] = [F.count(c[t]).alias(f"n_{i}") for i, t in enumerate(tickers)]
    # The matrix is symmetric: co-moments of the upper triangle (with the diagonal) only.
    for i, a in enumerate(tickers):
        for j, b in enumerate(tickers[i:], start=i):
            both = c[a].isNotNull() & c[b].isNotNull()
            x, y = F.when(both, c[a]), F.when(both, c[b])
            cov = F.covar_samp(x, y)
            den = F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
            aggs.append(F.try_divide(cov, den).alias(f"c_{i}_{j}"))
    m = wide.agg(*aggs)
    present = [F.col(f"n_{i}") > 0 for i in range(len(tickers))]
    n_present = sum((p.cast("int") for p in present), F.lit(0))
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("ticker_a"),
                F.lit(b).alias("ticker_b"),
                (present[i] & present[j]).alias("keep"),
                round_half_up(f"c_{min(i, j)}_{max(i, j)}", digits).alias("correlation"),
            )
            for i, a in enumerate(tickers)
            for j, b in enumerate(tickers)
        ]
    )
    return (
        m.where(n_present >= 2)
        .select(F.explode(cells).alias("cell"))
        .where(F.col("cell.keep"))
        .select("cell.ticker_a", "cell.ticker_b", "cell.correlation")
    )
