"""Period statistics, screener, tiers, rankings and the overview / sample queries.

Period logic: returns come from the full-history LAG (metrics are filtered *after* it), while
first/last price, running peak and drawdown restart inside the period.  Calendar counts and
percentile thresholds enter as scalar subqueries (one value each), never as cross joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean_of, pct_change, round_half_up, share_pct
from ..schemas import LIQUID_MIN_TURNOVER, TIER_HIGH_PCT, TIER_LABELS, TIER_LOW_PCT
from .metrics import KEY, with_drawdown


def _d(value) -> Column:
    return F.lit(str(value)).cast("date")


# --- Q1-Q3 ------------------------------------------------------------------------------------
def overview(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.countDistinct("instrument_id").alias("instruments_count"),
        F.count(F.lit(1)).alias("market_daily_stats_rows"),
        F.min("trade_date").alias("min_trade_date"),
        F.max("trade_date").alias("max_trade_date"),
        F.coalesce(F.sum("turnover_value"), F.lit(0)).cast("decimal(38,2)").alias("total_turnover_value"),
    )


def calendar_bounds(calendar: DataFrame) -> DataFrame:
    return calendar.where(F.col("is_trading_day")).agg(
        F.min("trade_date").alias("min_trade_date"), F.max("trade_date").alias("max_trade_date")
    )


def period_days(calendar: DataFrame, date_from, date_to) -> DataFrame:
    """Trading days in the inclusive period, as a one-row DataFrame."""
    return calendar.where(
        F.col("is_trading_day") & F.col("trade_date").between(_d(date_from), _d(date_to))
    ).agg(F.count(F.lit(1)).cast("int").alias("period_trading_days"))


# --- Q4 ---------------------------------------------------------------------------------------
def period_rows(metrics: DataFrame, date_from, date_to, tickers: list[str] | None = None) -> DataFrame:
    """Metrics rows inside the period (after the LAG); optional ticker list, which Catalyst
    pushes below the windows because the ticker is part of their partition key."""
    p = metrics.where(F.col("trade_date").between(_d(date_from), _d(date_to)))
    if tickers is not None:
        p = p.where(F.col("ticker").isin(list(tickers)))
    return p


def period_stats(
    metrics: DataFrame,
    calendar: DataFrame,
    date_from,
    date_to,
    tickers: list[str] | None = None,
) -> DataFrame:
    days = period_days(calendar, date_from, date_to).scalar()
    d = with_drawdown(period_rows(metrics, date_from, date_to, tickers))
    agg = d.groupBy(*KEY, "issuer_name").agg(
        F.min_by("price_avg_weighted", "trade_date").alias("first_price"),
        F.max_by("price_avg_weighted", "trade_date").alias("last_price"),
        mean_of("turnover_value").alias("avg_turnover_value"),
        mean_of("deals_count").alias("avg_deals_count"),
        F.count(F.lit(1)).alias("active_days_count"),  # rows in the period, not active days
        F.stddev_samp("daily_return_pct").alias("volatility_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        F.max("trade_date").alias("last_active_trade_date"),
    )
    return agg.select(
        *KEY,
        "issuer_name",
        "first_price",
        "last_price",
        pct_change("last_price", "first_price").alias("return_pct_period"),
        "avg_turnover_value",
        "avg_deals_count",
        "active_days_count",
        days.alias("period_trading_days"),
        share_pct("active_days_count", days).alias("active_days_share_pct"),
        "volatility_pct",
        "max_drawdown_pct",
        "last_active_trade_date",
    )


# --- Q5-Q6 ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class ScreenFilter:
    """Optional screener predicates; ``None`` = not applied.  A set predicate drops rows whose
    metric is NULL.  Compared on unrounded values."""

    min_return_pct: float | None = None
    max_volatility_pct: float | None = None
    min_avg_turnover_value: float | None = None
    min_avg_deals_count: float | None = None
    min_active_days_share_pct: float | None = None
    max_abs_drawdown_pct: float | None = None


def screen(stats: DataFrame, flt: ScreenFilter = ScreenFilter()) -> DataFrame:
    conds = []
    if flt.min_return_pct is not None:
        conds.append(F.col("return_pct_period") >= F.lit(flt.min_return_pct))
    if flt.max_volatility_pct is not None:
        conds.append(F.col("volatility_pct") <= F.lit(flt.max_volatility_pct))
    if flt.min_avg_turnover_value is not None:
        conds.append(F.col("avg_turnover_value") >= F.lit(flt.min_avg_turnover_value))
    if flt.min_avg_deals_count is not None:
        conds.append(F.col("avg_deals_count") >= F.lit(flt.min_avg_deals_count))
    if flt.min_active_days_share_pct is not None:
        conds.append(F.col("active_days_share_pct") >= F.lit(flt.min_active_days_share_pct))
    if flt.max_abs_drawdown_pct is not None:
        conds.append(F.abs("max_drawdown_pct") <= F.lit(flt.max_abs_drawdown_pct))
    s = stats
    for c in conds:
        s = s.where(F.coalesce(c, F.lit(False)))
    res = s.select(
        "ticker",
        "issuer_name",
        F.round("last_price", 4).cast("double").alias("last_price"),
        round_half_up("return_pct_period", 2).alias("return_pct_period"),
        round_half_up("avg_turnover_value", 2).alias("avg_turnover_value"),
        round_half_up("avg_deals_count", 2).alias("avg_deals_count"),
        "active_days_count",
        "period_trading_days",
        round_half_up("active_days_share_pct", 2).alias("active_days_share_pct"),
        round_half_up("volatility_pct", 2).alias("volatility_pct"),
        round_half_up("max_drawdown_pct", 2).alias("max_drawdown_pct"),
        "last_active_trade_date",
    )
    return res.orderBy(
        F.col("return_pct_period").desc_nulls_last(),
        F.col("avg_turnover_value").desc_nulls_last(),
        F.col("ticker"),
    )


def screen_headline(screened: DataFrame) -> DataFrame:
    """Result count and mean (rounded) return; 0.0 when there is none.  The rounded returns are
    summed as exact decimals, so the mean does not depend on summation order."""
    r = F.col("return_pct_period").cast("decimal(38,2)")
    return screened.agg(
        F.count(F.lit(1)).alias("result_count"),
        F.coalesce(
            F.try_divide(F.sum(r).cast("double"), F.count(r).cast("double")), F.lit(0.0)
        ).alias("mean_return_pct"),
    )


# --- Q7-Q8 ------------------------------------------------------------------------------------
def tickers(instruments: DataFrame) -> DataFrame:
    return instruments.select("ticker").orderBy("ticker")


def ticker_bounds(metrics: DataFrame, ticker: str | None = None) -> DataFrame:
    m = metrics if ticker is None else metrics.where(F.col("ticker") == F.lit(ticker))
    return m.groupBy("ticker").agg(
        F.min("trade_date").alias("min_trade_date"), F.max("trade_date").alias("max_trade_date")
    )


# --- Q9-Q10 -----------------------------------------------------------------------------------
BRACKET = 10_000  # accuracy of the approximate percentiles that bracket an exact one


def thresholds(summary: DataFrame) -> DataFrame:
    """percentile_cont 0.33 / 0.67 of average turnover and volatility (NULLs ignored), exact.

    Approximate percentiles bracket each threshold within a few ten-thousandths of the rows.  The
    values below a bracket are only counted; its own distinct values are ordered to pick the two
    neighbours of the position and interpolate, so no task ever sorts all instruments."""
    names = {
        ("avg_turnover_value", TIER_LOW_PCT): "turnover_p33", ("avg_turnover_value", TIER_HIGH_PCT): "turnover_p67",
        ("volatility_pct", TIER_LOW_PCT): "vol_p33", ("volatility_pct", TIER_HIGH_PCT): "vol_p67",
    }
    metrics = list(dict.fromkeys(m for m, _ in names))
    values = summary.unpivot([], metrics, "metric", "v").where(F.col("v").isNotNull())
    slack = 2.0 / BRACKET
    marks = [(p, max(p - slack, 0.0), min(p + slack, 1.0)) for p in (TIER_LOW_PCT, TIER_HIGH_PCT)]
    sides = F.percentile_approx("v", [x for _, a, b in marks for x in (a, b)], BRACKET)
    brackets = values.groupBy("metric").agg(
        sides.alias("q"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )  # a row for each metric
    few = F.col("n") <= 4 * BRACKET  # then the bracket, a few ranks wide, is everything
    asked = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.when(few, F.col("least")).otherwise(F.col("q")[2 * i]).alias("lo"),
                F.when(few, F.col("most")).otherwise(F.col("q")[2 * i + 1]).alias("hi"),
            )
            for i, (p, _, _) in enumerate(marks)
        ]
    )
    brackets = brackets.select("metric", "n", F.explode(asked).alias("a")).select("metric", "n", "a.*")
    near = values.join(F.broadcast(brackets), "metric").where(F.col("v") <= F.col("hi"))
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    counts = near.groupBy("metric", "p", "n", inside.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("metric", "p").orderBy(F.col("v").asc_nulls_first()))
    at = F.col("p") * (F.col("n") - 1)
    pick = lambda pos: F.min(F.when(F.col("upto") >= pos + 1, F.col("v")))
    found = counts.withColumn("upto", upto).withColumn("at", at).groupBy("metric", "p", "at").agg(
        pick(F.floor("at")).alias("a"), pick(F.ceil("at")).alias("b")
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.agg(
        *[F.max(F.when((F.col("metric") == m) & (F.col("p") == p), value)).alias(name) for (m, p), name in names.items()]
    )


def _tier(value: Column, lo: Column, hi: Column) -> Column:
    high, medium, low = TIER_LABELS
    # NULL value (or NULL threshold) falls through to "low".
    return F.when(value >= hi, F.lit(high)).when(value >= lo, F.lit(medium)).otherwise(F.lit(low))


def tiers(summary: DataFrame) -> DataFrame:
    """Liquidity and risk tier per instrument from the percentile thresholds."""
    t = thresholds(summary).select(F.struct("*").alias("t")).scalar()
    return summary.select(
        *KEY,
        _tier(F.col("avg_turnover_value"), t["turnover_p33"], t["turnover_p67"]).alias("liquidity_status"),
        _tier(F.col("volatility_pct"), t["vol_p33"], t["vol_p67"]).alias("risk_status"),
    )


# --- Q24-Q26 ----------------------------------------------------------------------------------
def _ntile(pos: Column, n: Column, k: int) -> Column:
    """NTILE(k) bucket of a 1-based position among n rows."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((pos - big - 1) / q) + 1
    ).cast("int")


def ranked_summary(summary: DataFrame, top: int = 15, groups: int = 3) -> DataFrame:
    """Liquidity group NTILE(3) by avg turnover (desc, nulls last, ticker) and RANK by return
    (desc, nulls last); first ``top`` rows by rank, ticker.

    Only ``top`` rows are needed, so there is neither a global window nor a join: the top rows come
    from a distributed top-k, and their turnover positions from one aggregate over all instruments
    that counts, for each of them, the rows ordered before it."""
    cols = ["ticker", "issuer_name", "return_pct_all_period", "avg_turnover_value", "volatility_pct", "max_drawdown_pct"]
    s = summary.select(*cols)
    head = s.orderBy(F.col("return_pct_all_period").desc_nulls_last(), "ticker").limit(top)
    rank = F.rank().over(Window.orderBy(F.col("return_pct_all_period").desc_nulls_last())).cast("int")
    heads = head.select(*cols, rank.alias("return_rank")).agg(F.collect_list(F.struct("*")).alias("h")).scalar()

    def before(i: int) -> Column:
        turnover, ticker = F.get(heads, F.lit(i))["avg_turnover_value"], F.get(heads, F.lit(i))["ticker"]
        own = F.col("avg_turnover_value")
        return (
            (own.isNotNull() & turnover.isNull())
            | (own > turnover)
            | (own.eqNullSafe(turnover) & (F.col("ticker") < ticker))
        )

    ahead = [F.sum(F.when(before(i), 1).otherwise(0)) for i in range(top)]
    counted = s.agg(F.array(*ahead).alias("ahead"), F.count(F.lit(1)).alias("n"))
    rows = counted.select("ahead", "n", F.posexplode(heads).alias("i", "h"))
    group = _ntile(F.col("ahead")[F.col("i")] + 1, F.col("n"), groups)
    return rows.select(*[F.col(f"h.{c}").alias(c) for c in cols], group.alias("liquidity_group"), "h.return_rank").orderBy(
        "return_rank", "ticker"
    )


def top_returns(summary: DataFrame, n: int = 20) -> DataFrame:
    return (
        summary.select(
            "ticker",
            "issuer_name",
            "first_trade_date",
            "last_trade_date",
            "first_price",
            "last_price",
            "return_pct_all_period",
            "avg_turnover_value",
            "avg_deals_count",
            "active_days_share_pct",
            "volatility_pct",
            "max_drawdown_pct",
            "last_active_trade_date",
        )
        .orderBy(F.col("return_pct_all_period").desc_nulls_last(), "ticker")
        .limit(n)
    )


def liquid_top_returns(summary: DataFrame, min_turnover: float = LIQUID_MIN_TURNOVER, n: int = 10) -> DataFrame:
    return (
        summary.where(F.col("avg_turnover_value") >= F.lit(min_turnover))
        .select("ticker", "issuer_name", "return_pct_all_period", "avg_turnover_value", "volatility_pct")
        .orderBy(F.col("return_pct_all_period").desc_nulls_last(), "ticker")
        .limit(n)
    )


def latest_metrics(metrics: DataFrame, n: int = 20) -> DataFrame:
    return (
        metrics.select(
            "ticker",
            "issuer_name",
            "trade_date",
            "price_avg_weighted",
            "prev_price_avg_weighted",
            "price_change_abs",
            "daily_return_pct",
            "intraday_range_pct",
            "is_active_day",
        )
        .orderBy(F.col("trade_date").desc(), "ticker")
        .limit(n)
    )


def latest_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    return (
        anomalies.select(
            "trade_date",
            "ticker",
            "issuer_name",
            "anomaly_type",
            "anomaly_value_pct",
            "price_avg_weighted",
            "turnover_value",
            "deals_count",
        )
        .orderBy(F.col("trade_date").desc(), F.abs("anomaly_value_pct").desc(), "ticker", "anomaly_type")
        .limit(n)
    )


# --- Q27 --------------------------------------------------------------------------------------
def ticker_slice(facts: DataFrame, instruments: DataFrame, ticker: str, date_from, date_to) -> DataFrame:
    f = facts.where(F.col("trade_date").between(_d(date_from), _d(date_to)))
    i = instruments.where(F.col("ticker") == F.lit(ticker)).select("instrument_id", F.col("ticker").alias("i_ticker"))
    return (
        f.join(i, "instrument_id")
        .select("trade_date", F.col("i_ticker").alias("ticker"), "price_avg_weighted", "turnover_value")
        .orderBy("trade_date")
    )
