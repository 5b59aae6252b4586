"""Registered analyst queries: overview, period statistics, screener, tiers, card, comparison,
anomaly search and the sample / top-N views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_half_up
from ..operators import anomalies as A
from ..operators import card as C
from ..operators import compare as P
from ..operators import screening as Q
from ..operators import sketches as K
from ..operators.comoments import correlation_matrix
from ..schemas import TIER_HIGH_PCT, TIER_LOW_PCT
from . import oracle_sql as S
from .q_core import ANOMALY_SQL
from .registry import CARD_TICKER, COMPARE_TICKERS, DATE_FROM, DATE_TO, date_lit, out, register, wh

SCREEN_FILTER = Q.ScreenFilter(min_return_pct=0.0, max_volatility_pct=1500.0)
ALL_FILTERS = Q.ScreenFilter(-50.0, 2000.0, 1000.0, 1.0, 1.0, 99.9)  # every predicate set
SEARCH_TYPES = ("price_jump", "deals_spike")
SEARCH_MIN_ABS = 10.0

BETWEEN = f"trade_date BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def period_sql(tickers=None, name: str = "ps") -> str:
    """Period statistics: one group for each ticker over the period's rows."""
    tick = f" AND ticker IN ({_in(tickers)})" if tickers else ""
    first, last = S.first_value("price_avg_weighted"), S.last_value("price_avg_weighted")
    days = f"(SELECT count(*)::INTEGER FROM trading_calendar WHERE is_trading_day AND {BETWEEN})"
    return (
        f"{name}_rows AS (SELECT * FROM metrics WHERE {BETWEEN}{tick}),\n"
        + S.drawdown_cte(f"{name}_rows", f"{name}_days")
        + f""",
{name} AS (
  SELECT ticker, issuer_name, {first} AS first_price, {last} AS last_price, {S.pct(last, first)} AS return_pct_period,
         {S.mean('turnover_value')} AS avg_turnover_value, {S.mean('deals_count')} AS avg_deals_count,
         count(*) AS active_days_count, {days} AS period_trading_days,
         CAST(count(*) AS DOUBLE) / nullif({days}, 0) * 100 AS active_days_share_pct,
         stddev_samp(daily_return_pct) AS volatility_pct, min(drawdown_pct) AS max_drawdown_pct,
         max(trade_date) AS last_active_trade_date
  FROM {name}_days GROUP BY ticker, issuer_name)"""
    )


def _cal_sql() -> str:
    return S.calendar_cte()


PERIOD_OUT = [
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
    "last_active_trade_date",
]
PERIOD_SQL = (
    "ticker, issuer_name, CAST(first_price AS DOUBLE) AS first_price, CAST(last_price AS DOUBLE) AS last_price, "
    "return_pct_period, avg_turnover_value, avg_deals_count, active_days_count, period_trading_days, "
    f"active_days_share_pct, {S.rnd('volatility_pct', 4)} AS volatility_pct, max_drawdown_pct, last_active_trade_date"
)


def _period_out(df, cols=PERIOD_OUT):
    return out(df.withColumn("volatility_pct", round_half_up("volatility_pct", 4)), *cols)


def _screen_sql(flt: Q.ScreenFilter) -> str:
    limits = {
        "return_pct_period >=": flt.min_return_pct,
        "volatility_pct <=": flt.max_volatility_pct,
        "avg_turnover_value >=": flt.min_avg_turnover_value,
        "avg_deals_count >=": flt.min_avg_deals_count,
        "active_days_share_pct >=": flt.min_active_days_share_pct,
        "abs(max_drawdown_pct) <=": flt.max_abs_drawdown_pct,
    }
    conds = [f"{k} {v}" for k, v in limits.items() if v is not None]
    where = (" WHERE " + " AND ".join(conds)) if conds else ""
    return (
        "SELECT ticker, issuer_name, CAST(ROUND(last_price, 4) AS DOUBLE) AS last_price, "
        f"{S.rnd('return_pct_period', 2)} AS return_pct_period, {S.rnd('avg_turnover_value', 2)} AS avg_turnover_value, "
        f"{S.rnd('avg_deals_count', 2)} AS avg_deals_count, active_days_count, period_trading_days, "
        f"{S.rnd('active_days_share_pct', 2)} AS active_days_share_pct, {S.rnd('volatility_pct', 2)} AS volatility_pct, "
        f"{S.rnd('max_drawdown_pct', 2)} AS max_drawdown_pct, last_active_trade_date FROM ps{where}"
    )


def _base_cal(*extra: str) -> str:
    return S.base(_cal_sql(), *extra)


# --- Q1, Q2, Q7, Q8 ---------------------------------------------------------------------------
@register(
    "overview",
    S.base()
    + "SELECT COUNT(DISTINCT ticker) AS instruments_count, COUNT(*) AS market_daily_stats_rows, "
    "MIN(trade_date) AS min_trade_date, MAX(trade_date) AS max_trade_date, "
    "CAST(COALESCE(SUM(turnover_value), 0) AS DOUBLE) AS total_turnover_value FROM facts",
)
def q_overview(spark, sf_dir):
    return out(Q.overview(wh(spark, sf_dir).facts))


@register(
    "calendar_bounds",
    _base_cal() + "SELECT MIN(trade_date) AS min_trade_date, MAX(trade_date) AS max_trade_date "
    "FROM trading_calendar WHERE is_trading_day",
)
def q_calendar_bounds(spark, sf_dir):
    return Q.calendar_bounds(wh(spark, sf_dir).calendar)


@register("tickers", S.base() + "SELECT ticker FROM instruments")
def q_tickers(spark, sf_dir):
    return Q.tickers(wh(spark, sf_dir).instruments)


@register(
    "ticker_bounds",
    S.base() + "SELECT ticker, MIN(trade_date) AS min_trade_date, MAX(trade_date) AS max_trade_date "
    "FROM metrics GROUP BY ticker",
)
def q_ticker_bounds(spark, sf_dir):
    return Q.ticker_bounds(wh(spark, sf_dir).metrics)


# --- Q4-Q6 ------------------------------------------------------------------------------------
@register("period_stats", _base_cal(period_sql()) + f"SELECT {PERIOD_SQL} FROM ps")
def q_period_stats(spark, sf_dir):
    w = wh(spark, sf_dir)
    return _period_out(Q.period_stats(w.metrics, w.calendar, DATE_FROM, DATE_TO))


def _screened(spark, sf_dir, flt):
    w = wh(spark, sf_dir)
    return Q.screen(Q.period_stats(w.metrics, w.calendar, DATE_FROM, DATE_TO), flt)


@register("screener", _base_cal(period_sql()) + _screen_sql(Q.ScreenFilter()))
def q_screener(spark, sf_dir):
    return _screened(spark, sf_dir, Q.ScreenFilter())


@register("screener_filtered", _base_cal(period_sql()) + _screen_sql(SCREEN_FILTER))
def q_screener_filtered(spark, sf_dir):
    return _screened(spark, sf_dir, SCREEN_FILTER)


@register("screener_all_filters", _base_cal(period_sql()) + _screen_sql(ALL_FILTERS))
def q_screener_all_filters(spark, sf_dir):
    return _screened(spark, sf_dir, ALL_FILTERS)


@register(
    "screen_headline",
    _base_cal(period_sql(), "scr AS (" + _screen_sql(SCREEN_FILTER) + ")")
    + "SELECT COUNT(*) AS result_count, COALESCE(CAST(SUM(CAST(return_pct_period AS DECIMAL(38,2))) AS DOUBLE) "
    "/ COUNT(return_pct_period), 0.0) AS mean_return_pct FROM scr",
)
def q_screen_headline(spark, sf_dir):
    return Q.screen_headline(_screened(spark, sf_dir, SCREEN_FILTER))


# --- Q9, Q10, Q24-Q27 -------------------------------------------------------------------------
@register(
    "thresholds",
    S.base(S.summary_cte())
    + f"SELECT {S.rnd('quantile_cont(avg_turnover_value, 0.33)', 4)} AS turnover_p33, "
    f"{S.rnd('quantile_cont(avg_turnover_value, 0.67)', 4)} AS turnover_p67, "
    f"{S.rnd('quantile_cont(volatility_pct, 0.33)', 4)} AS vol_p33, "
    f"{S.rnd('quantile_cont(volatility_pct, 0.67)', 4)} AS vol_p67 FROM summary",
)
def q_thresholds(spark, sf_dir):
    t = Q.thresholds(wh(spark, sf_dir, keep=False).summary)
    return t.select(*[round_half_up(c, 4).alias(c) for c in t.columns])


@register(
    "tiers",
    S.base(
        S.summary_cte(),
        "t AS (SELECT quantile_cont(avg_turnover_value, 0.33) AS tp33, quantile_cont(avg_turnover_value, 0.67) AS tp67, "
        "quantile_cont(volatility_pct, 0.33) AS vp33, quantile_cont(volatility_pct, 0.67) AS vp67 FROM summary)",
    )
    + "SELECT s.ticker, CASE WHEN s.avg_turnover_value >= t.tp67 THEN 'high' WHEN s.avg_turnover_value >= t.tp33 "
    "THEN 'medium' ELSE 'low' END AS liquidity_status, CASE WHEN s.volatility_pct >= t.vp67 THEN 'high' "
    "WHEN s.volatility_pct >= t.vp33 THEN 'medium' ELSE 'low' END AS risk_status FROM summary s CROSS JOIN t",
)
def q_tiers(spark, sf_dir):
    return Q.tiers(wh(spark, sf_dir).summary).select("ticker", "liquidity_status", "risk_status")


@register(
    "ranked_summary",
    S.base(S.summary_cte())
    + f"SELECT ticker, issuer_name, return_pct_all_period, avg_turnover_value, {S.rnd('volatility_pct', 4)} AS volatility_pct, "
    "max_drawdown_pct, CAST(NTILE(3) OVER (ORDER BY avg_turnover_value DESC NULLS LAST, ticker) AS INTEGER) AS liquidity_group, "
    "CAST(RANK() OVER (ORDER BY return_pct_all_period DESC NULLS LAST) AS INTEGER) AS return_rank "
    "FROM summary ORDER BY return_rank, ticker LIMIT 15",
)
def q_ranked_summary(spark, sf_dir):
    r = Q.ranked_summary(wh(spark, sf_dir).summary)
    return r.withColumn("volatility_pct", round_half_up("volatility_pct", 4))


TOP_COLS = [
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
]


@register(
    "top_returns",
    S.base(S.summary_cte())
    + "SELECT ticker, issuer_name, first_trade_date, last_trade_date, CAST(first_price AS DOUBLE) AS first_price, "
    "CAST(last_price AS DOUBLE) AS last_price, return_pct_all_period, avg_turnover_value, avg_deals_count, "
    f"active_days_share_pct, {S.rnd('volatility_pct', 4)} AS volatility_pct, max_drawdown_pct, last_active_trade_date "
    "FROM summary ORDER BY return_pct_all_period DESC NULLS LAST, ticker LIMIT 20",
)
def q_top_returns(spark, sf_dir):
    t = Q.top_returns(wh(spark, sf_dir).summary)
    return out(t.withColumn("volatility_pct", round_half_up("volatility_pct", 4)), *TOP_COLS)


@register(
    "liquid_top_returns",
    S.base(S.summary_cte())
    + f"SELECT ticker, issuer_name, return_pct_all_period, avg_turnover_value, {S.rnd('volatility_pct', 4)} AS volatility_pct "
    "FROM summary WHERE avg_turnover_value >= 10000 ORDER BY return_pct_all_period DESC NULLS LAST, ticker LIMIT 10",
)
def q_liquid_top_returns(spark, sf_dir):
    t = Q.liquid_top_returns(wh(spark, sf_dir).summary)
    return t.withColumn("volatility_pct", round_half_up("volatility_pct", 4))


@register(
    "latest_metrics",
    S.base()
    + "SELECT ticker, issuer_name, trade_date, CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, "
    "CAST(prev_price_avg_weighted AS DOUBLE) AS prev_price_avg_weighted, price_change_abs, daily_return_pct, "
    "intraday_range_pct, is_active_day FROM metrics ORDER BY trade_date DESC, ticker LIMIT 20",
)
def q_latest_metrics(spark, sf_dir):
    return out(Q.latest_metrics(wh(spark, sf_dir).metrics))


@register(
    "latest_anomalies",
    S.base(S.anomalies_cte())
    + "SELECT trade_date, ticker, issuer_name, anomaly_type, anomaly_value_pct, "
    "CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, CAST(turnover_value AS DOUBLE) AS turnover_value, "
    "deals_count FROM anomalies ORDER BY trade_date DESC, abs(anomaly_value_pct) DESC, ticker, anomaly_type LIMIT 20",
)
def q_latest_anomalies(spark, sf_dir):
    return out(Q.latest_anomalies(wh(spark, sf_dir).anomalies))


@register(
    "ticker_slice",
    S.base()
    + "SELECT f.trade_date, i.ticker, CAST(f.price_avg_weighted AS DOUBLE) AS price_avg_weighted, "
    "CAST(f.turnover_value AS DOUBLE) AS turnover_value FROM facts f JOIN instruments i ON i.ticker = f.ticker "
    f"WHERE i.ticker = '{CARD_TICKER}' AND f.{BETWEEN}",
)
def q_ticker_slice(spark, sf_dir):
    w = wh(spark, sf_dir)
    return out(Q.ticker_slice(w.facts, w.instruments, CARD_TICKER, DATE_FROM, DATE_TO))


# --- Q11-Q15: instrument card -----------------------------------------------------------------
def _card_sql() -> str:
    """Per ticker: the period's aggregates, and the price as of 30 and 90 days before its end."""
    earlier = "".join(
        f""",
p{n} AS (
  SELECT t.ticker, r.price_avg_weighted AS price_{n}d
  FROM (SELECT ticker, DATE '{DATE_TO}' - {n} AS day FROM instruments) t
  ASOF JOIN cp_rows r ON t.ticker = r.ticker AND t.day >= r.trade_date)"""
        for n in (30, 90)
    )
    return (
        f"cp_days_count AS (SELECT count(*)::INTEGER AS period_trading_days FROM trading_calendar WHERE is_trading_day AND {BETWEEN}),\n"
        f"cp_rows AS (SELECT * FROM metrics WHERE {BETWEEN}),\n"
        + S.drawdown_cte("cp_rows", "cp_days")
        + f""",
card AS (
  SELECT ticker, any_value(issuer_name) AS issuer_name, any_value(currency_code) AS currency_code,
         any_value(instrument_type) AS instrument_type, max(trade_date) AS last_trade_date,
         {S.last_value('price_avg_weighted')} AS last_price, {S.last_value('prev_price_avg_weighted')} AS last_prev,
         {S.mean('turnover_value')} AS avg_turnover_value, {S.mean('deals_count')} AS avg_deals_count,
         count(*) AS active_days_count, stddev_samp(daily_return_pct) AS volatility_pct,
         min(drawdown_pct) AS max_drawdown_pct
  FROM cp_days GROUP BY ticker)"""
        + earlier
    )


@register(
    "card_kpi",
    _base_cal(_card_sql())
    + "SELECT i.ticker, c.issuer_name, c.currency_code, c.instrument_type, c.last_trade_date, "
    "CAST(c.last_price AS DOUBLE) AS last_price, "
    f"{S.pct('c.last_price', 'c.last_prev')} AS change_day_pct, {S.pct('c.last_price', 'p30.price_30d')} AS change_30d_pct, "
    f"{S.pct('c.last_price', 'p90.price_90d')} AS change_90d_pct, c.avg_turnover_value, c.avg_deals_count, "
    "coalesce(c.active_days_count, 0) AS active_days_count, n.period_trading_days, "
    "CAST(coalesce(c.active_days_count, 0) AS DOUBLE) / nullif(n.period_trading_days, 0) * 100 AS active_days_share_pct, "
    f"{S.rnd('c.volatility_pct', 4)} AS volatility_pct, c.max_drawdown_pct "
    "FROM instruments i CROSS JOIN cp_days_count n LEFT JOIN card c USING (ticker) LEFT JOIN p30 USING (ticker) LEFT JOIN p90 USING (ticker)",
)
def q_card_kpi(spark, sf_dir):
    w = wh(spark, sf_dir)
    k = C.card_kpis(w.metrics, w.calendar, w.instruments, DATE_FROM, DATE_TO)
    return out(k.withColumn("volatility_pct", round_half_up("volatility_pct", 4)), *C.CARD_COLUMNS)


@register(
    "asof_change",
    _base_cal(_card_sql())
    + "SELECT l.ticker, l.last_trade_date, CAST(l.last_price AS DOUBLE) AS last_price, "
    "CAST(p30.price_30d AS DOUBLE) AS price_30d, CAST(p90.price_90d AS DOUBLE) AS price_90d, "
    f"{S.pct('l.last_price', 'p30.price_30d')} AS change_30d_pct, {S.pct('l.last_price', 'p90.price_90d')} AS change_90d_pct "
    "FROM card l LEFT JOIN p30 ON p30.ticker = l.ticker LEFT JOIN p90 ON p90.ticker = l.ticker",
)
def q_asof_change(spark, sf_dir):
    return out(C.asof_change(wh(spark, sf_dir).metrics, DATE_FROM, DATE_TO))


@register(
    "price_history",
    S.base() + "SELECT trade_date, CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted FROM metrics "
    f"WHERE ticker = '{CARD_TICKER}' AND {BETWEEN}",
)
def q_price_history(spark, sf_dir):
    return out(C.price_history(wh(spark, sf_dir).metrics, CARD_TICKER, DATE_FROM, DATE_TO))


@register(
    "activity_history",
    S.base() + "SELECT trade_date, CAST(turnover_value AS DOUBLE) AS turnover_value, deals_count FROM metrics "
    f"WHERE ticker = '{CARD_TICKER}' AND {BETWEEN}",
)
def q_activity_history(spark, sf_dir):
    return out(C.activity_history(wh(spark, sf_dir).metrics, CARD_TICKER, DATE_FROM, DATE_TO))


@register(
    "card_anomalies",
    S.base(S.anomalies_cte())
    + "SELECT trade_date, anomaly_type, anomaly_value_pct, CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, "
    "CAST(turnover_value AS DOUBLE) AS turnover_value, deals_count FROM anomalies "
    f"WHERE ticker = '{CARD_TICKER}' AND {BETWEEN} ORDER BY trade_date DESC, anomaly_type LIMIT 20",
)
def q_card_anomalies(spark, sf_dir):
    return out(C.card_anomalies(wh(spark, sf_dir).anomalies, CARD_TICKER, DATE_FROM, DATE_TO))


# --- Q16-Q19: comparison ----------------------------------------------------------------------
CMP_OUT = [c for c in PERIOD_OUT if c != "last_active_trade_date"]


@register(
    "comparison",
    _base_cal(period_sql(COMPARE_TICKERS))
    + "SELECT " + PERIOD_SQL.replace(", last_active_trade_date", "") + " FROM ps",
)
def q_comparison(spark, sf_dir):
    w = wh(spark, sf_dir)
    return _period_out(P.compare(w.metrics, w.calendar, COMPARE_TICKERS, DATE_FROM, DATE_TO), CMP_OUT)


HIST_SQL = (
    "h AS (SELECT trade_date, ticker, price_avg_weighted, daily_return_pct FROM metrics "
    f"WHERE ticker IN ({_in(COMPARE_TICKERS)}) AND {BETWEEN})"
)


@register(
    "comparison_history",
    S.base(HIST_SQL)
    + "SELECT trade_date, ticker, CAST(price_avg_weighted AS DOUBLE) AS price_avg_weighted, daily_return_pct FROM h",
)
def q_comparison_history(spark, sf_dir):
    return out(P.compare_history(wh(spark, sf_dir).metrics, COMPARE_TICKERS, DATE_FROM, DATE_TO))


@register(
    "price_index",
    S.base(
        HIST_SQL,
        "hp AS (SELECT trade_date, ticker, price_avg_weighted AS p FROM h WHERE price_avg_weighted IS NOT NULL)",
        "d AS (SELECT DISTINCT trade_date FROM hp)",
        "b AS (SELECT ticker, arg_min(p, trade_date) AS base FROM hp GROUP BY ticker)",
        "g AS (SELECT d.trade_date, b.ticker, b.base, hp.p FROM d CROSS JOIN b "
        "LEFT JOIN hp ON hp.trade_date = d.trade_date AND hp.ticker = b.ticker)",
        "f AS (SELECT trade_date, ticker, base, last_value(p IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY trade_date "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pf FROM g)",
        "i AS (SELECT trade_date, ticker, CASE WHEN base = 0 THEN NULL ELSE CAST(pf AS DOUBLE) / CAST(base AS DOUBLE) * 100 END "
        "AS price_index FROM f)",
    )
    + "SELECT * FROM i WHERE trade_date IN (SELECT trade_date FROM i WHERE price_index IS NOT NULL)",
)
def q_price_index(spark, sf_dir):
    h = P.compare_history(wh(spark, sf_dir).metrics, COMPARE_TICKERS, DATE_FROM, DATE_TO, ordered=False)
    return P.price_index(h, COMPARE_TICKERS)


@register(
    "correlation",
    S.base(
        HIST_SQL,
        "hr AS (SELECT trade_date, ticker, daily_return_pct AS r FROM h WHERE daily_return_pct IS NOT NULL)",
        "pt AS (SELECT DISTINCT ticker FROM hr)",
        "cc AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, "
        "covar_samp(a.r, b.r) / NULLIF(stddev_samp(a.r) * stddev_samp(b.r), 0) AS c "
        "FROM hr a JOIN hr b ON a.trade_date = b.trade_date GROUP BY a.ticker, b.ticker)",
    )
    + f"SELECT p1.ticker AS ticker_a, p2.ticker AS ticker_b, {S.rnd('cc.c', 3)} AS correlation "
    "FROM pt p1 CROSS JOIN pt p2 LEFT JOIN cc ON cc.ticker_a = p1.ticker AND cc.ticker_b = p2.ticker "
    "WHERE (SELECT COUNT(*) FROM pt) >= 2",
)
def q_correlation(spark, sf_dir):
    h = P.compare_history(wh(spark, sf_dir).metrics, COMPARE_TICKERS, DATE_FROM, DATE_TO, ordered=False)
    return P.correlation(h, COMPARE_TICKERS)


_SHARES = (TIER_LOW_PCT, TIER_HIGH_PCT)


@register(
    "sketched_thresholds",
    S.base(S.summary_cte(), "v AS (UNPIVOT (SELECT avg_turnover_value, volatility_pct FROM summary) ON avg_turnover_value, volatility_pct INTO NAME metric VALUE x)")
    + f"SELECT metric, p, count(*) AS n, TRUE AS within_bound FROM v, (SELECT unnest([{_SHARES[0]}, {_SHARES[1]}])::DOUBLE AS p) GROUP BY ALL",
)
def q_sketched_thresholds(spark, sf_dir):
    """Tier thresholds from quantile sketches, held against all values: is each within the stated rank
    error?"""
    summary = wh(spark, sf_dir).summary
    found = K.quantiles(K.sketch_values(summary, ["avg_turnover_value", "volatility_pct"]), *_SHARES)
    return K.rank_errors(summary, found).select("metric", "p", "n", (F.col("rank_error") <= K.RANK_ERROR).alias("within_bound"))


@register(
    "sketched_months",
    S.base()
    + "SELECT metric, 0.5::DOUBLE AS p, count(*) AS n, TRUE AS within_bound FROM (UNPIVOT (SELECT CAST(turnover_value AS DOUBLE) AS turnover_value, "
    f"daily_return_pct FROM metrics WHERE {BETWEEN}) ON turnover_value, daily_return_pct INTO NAME metric VALUE x) GROUP BY metric",
)
def q_sketched_months(spark, sf_dir):
    """Medians of daily values over the period, merged from one sketch for each month."""
    metrics, columns = wh(spark, sf_dir, keep=False).metrics, ["turnover_value", "daily_return_pct"]
    stored = K.month_sketches(metrics, columns)
    found = K.period_quantiles(stored, int(DATE_FROM[:7].replace("-", "")), int(DATE_TO[:7].replace("-", "")), 0.5)
    rows = metrics.where(F.col("trade_date").between(date_lit(DATE_FROM), date_lit(DATE_TO)))
    return K.rank_errors(rows, found).select("metric", "p", "n", (F.col("rank_error") <= K.RANK_ERROR).alias("within_bound"))


@register(
    "asof_month_ends",
    S.base(
        "b AS (SELECT ticker, min(trade_date) AS d0, max(trade_date) AS d1 FROM metrics GROUP BY ticker)",
        "c AS (SELECT ticker, last_day(CAST(unnest(generate_series(date_trunc('month', d0 - INTERVAL 1 MONTH)::TIMESTAMP, "
        "date_trunc('month', d1)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE)) AS cutoff FROM b)",
    )
    + "SELECT c.ticker, c.cutoff, m.trade_date AS asof_date, CAST(m.price_avg_weighted AS DOUBLE) AS price "
    "FROM c ASOF LEFT JOIN metrics m ON c.ticker = m.ticker AND c.cutoff >= m.trade_date",
)
def q_asof_month_ends(spark, sf_dir):
    """Month-end prices of every ticker, from the month before its first row to its last."""
    m = wh(spark, sf_dir).metrics
    month = F.expr("interval 1 month")
    span = m.groupBy("ticker").agg(F.trunc(F.min("trade_date"), "month").alias("d0"), F.trunc(F.max("trade_date"), "month").alias("d1"))
    months = span.select("ticker", F.explode(F.sequence(F.add_months("d0", -1), "d1", month)).alias("m"))
    return out(C.asof_prices(m, months.select("ticker", F.last_day("m").alias("cutoff"))))


@register(
    "correlation_matrix",
    S.base(
        f"hr AS (SELECT trade_date, ticker, daily_return_pct AS r FROM metrics WHERE {BETWEEN} AND daily_return_pct IS NOT NULL)",
        "pt AS (SELECT DISTINCT ticker FROM hr)",
        "cc AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, "
        "covar_samp(a.r, b.r) / NULLIF(stddev_samp(a.r) * stddev_samp(b.r), 0) AS c "
        "FROM hr a JOIN hr b ON a.trade_date = b.trade_date GROUP BY a.ticker, b.ticker)",
    )
    + f"SELECT p1.ticker AS ticker_a, p2.ticker AS ticker_b, {S.rnd('cc.c', 3)} AS correlation "
    "FROM pt p1 CROSS JOIN pt p2 LEFT JOIN cc ON cc.ticker_a = p1.ticker AND cc.ticker_b = p2.ticker "
    "WHERE (SELECT COUNT(*) FROM pt) >= 2",
)
def q_correlation_matrix(spark, sf_dir):
    """Correlation of every pair of tickers in the period."""
    day = F.col("trade_date")
    rows = wh(spark, sf_dir, keep=False).metrics.where(day.between(date_lit(DATE_FROM), date_lit(DATE_TO)))
    return correlation_matrix(rows.select("trade_date", "ticker", "daily_return_pct"), block=32)


# --- Q20-Q23: anomaly search ------------------------------------------------------------------
SEARCH_SQL = (
    f"search AS (SELECT {ANOMALY_SQL} FROM anomalies WHERE {BETWEEN} AND anomaly_type IN ({_in(SEARCH_TYPES)}) "
    f"AND abs(anomaly_value_pct) >= {SEARCH_MIN_ABS})"
)


def _search(spark, sf_dir):
    return A.search_anomalies(wh(spark, sf_dir, keep=False).anomalies, DATE_FROM, DATE_TO, None, SEARCH_TYPES, SEARCH_MIN_ABS)


@register("anomaly_search", S.base(S.anomalies_cte(), SEARCH_SQL) + "SELECT * FROM search")
def q_anomaly_search(spark, sf_dir):
    return out(_search(spark, sf_dir))


@register(
    "anomaly_headline",
    S.base(S.anomalies_cte(), SEARCH_SQL)
    + "SELECT COUNT(*) AS anomalies_count, COUNT(DISTINCT ticker) AS tickers_count, "
    "COALESCE(MAX(abs(anomaly_value_pct)), 0.0) AS max_abs_value_pct FROM search",
)
def q_anomaly_headline(spark, sf_dir):
    return A.anomaly_headline(_search(spark, sf_dir))


@register(
    "anomalies_by_type",
    S.base(S.anomalies_cte(), SEARCH_SQL) + 'SELECT anomaly_type, COUNT(*) AS "count" FROM search GROUP BY anomaly_type',
)
def q_anomalies_by_type(spark, sf_dir):
    return A.anomalies_by_type(_search(spark, sf_dir))


@register(
    "anomalies_by_ticker",
    S.base(S.anomalies_cte(), SEARCH_SQL)
    + 'SELECT ticker, COUNT(*) AS "count" FROM search GROUP BY ticker ORDER BY "count" DESC, ticker LIMIT 10',
)
def q_anomalies_by_ticker(spark, sf_dir):
    return A.anomalies_by_ticker(_search(spark, sf_dir))
