"""Edge rows for metrics, summary, anomalies, period statistics, card, comparison."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tradelake.operators import anomalies as A
from tradelake.operators import card as C
from tradelake.operators import compare as P
from tradelake.operators import metrics as M
from tradelake.operators import screening as Q
from tradelake.plans.warehouse import Warehouse

from .conftest import day, make_raw, raw_row


def wh_prices(spark, series: dict[str, list], **kw):
    """Warehouse with one raw row per (ticker, day); ``None`` price keeps the row (NULL price)."""
    rows = []
    for t, prices in series.items():
        for i, p in enumerate(prices):
            if p == "skip":
                continue
            rows.append(raw_row(ticker_raw=t, price_avg_raw=p, trade_datetime_raw=day(i), **kw))
    return Warehouse.from_raw(spark, make_raw(spark, rows))


def metrics_list(w, ticker="AAA"):
    return sorted((r for r in w.metrics.collect() if r.ticker == ticker), key=lambda r: r.trade_date)


def test_daily_return_sequence(spark):
    m = metrics_list(wh_prices(spark, {"AAA": [10, 12, None, 15]}))
    assert [r.daily_return_pct for r in m] == [None, 20.0, None, None]


def test_previous_price_zero(spark):
    m = metrics_list(wh_prices(spark, {"AAA": [0, 5]}))
    assert m[1].daily_return_pct is None and m[1].price_change_abs == 5.0


def test_drawdown_and_max_drawdown(spark):
    w = wh_prices(spark, {"AAA": [10, 20, 15]})
    d = sorted(M.with_drawdown(w.metrics).collect(), key=lambda r: r.trade_date)
    assert [r.drawdown_pct for r in d] == [0.0, 0.0, -25.0]
    assert w.summary.collect()[0].max_drawdown_pct == -25.0


def test_first_price_null(spark):
    s = wh_prices(spark, {"AAA": [None, 5, 6]}).summary.collect()[0]
    assert s.first_price is None and s.return_pct_all_period is None


def test_one_fact_volatility_null_and_dropped_by_bound(spark):
    w = wh_prices(spark, {"AAA": [10]})
    assert w.summary.collect()[0].volatility_pct is None
    stats = Q.period_stats(w.metrics, w.calendar, "2024-01-01", "2024-12-31")
    assert Q.screen(stats, Q.ScreenFilter(max_volatility_pct=1e9)).count() == 0
    assert Q.screen(stats).count() == 1


def test_inactive_day_counts_in_totals(spark):
    raw = make_raw(
        spark,
        [raw_row(trade_datetime_raw=day(0)), raw_row(trade_datetime_raw=day(1), turnover_value_raw=0, deals_count_raw=None)],
    )
    w = Warehouse.from_raw(spark, raw)
    m = metrics_list(w)
    assert [r.is_active_day for r in m] == [True, False]
    s = w.summary.collect()[0]
    assert (s.active_days_count, s.total_days_count, s.active_days_share_pct) == (1, 2, 50.0)
    p = Q.period_stats(w.metrics, w.calendar, "2024-01-01", "2024-01-31").collect()[0]
    assert p.active_days_count == 2  # rows in the period, not active days


def _spike_rows(values, field):
    return [raw_row(trade_datetime_raw=day(i), **{field: v}) for i, v in enumerate(values)]


def test_turnover_spike_boundary(spark):
    w = Warehouse.from_raw(spark, make_raw(spark, _spike_rows([100, 100, 250], "turnover_value_raw")))
    a = [r for r in w.anomalies.collect() if r.anomaly_type == "turnover_spike"]
    assert len(a) == 1 and a[0].anomaly_value_pct == 150.0 and a[0].trade_date == day(2).date()


def test_jump_floor(spark):
    a = wh_prices(spark, {"AAA": [100, 101.5]}).anomalies.collect()
    assert [(r.anomaly_type, r.anomaly_value_pct) for r in a] == [("price_jump", 1.5)]


def test_trailing_window_excludes_current_and_spans_20_rows(spark):
    w = Warehouse.from_raw(spark, make_raw(spark, _spike_rows(list(range(1, 23)), "deals_count_raw")))
    b = sorted(A.trailing_baseline(w.metrics).collect(), key=lambda r: r.trade_date)
    assert b[0].avg_deals_prev20 is None
    assert b[21].avg_deals_prev20 == sum(range(2, 22)) / 20  # row 22 averages rows 2..21


def test_asof_30_days(spark):
    raw = make_raw(
        spark,
        [
            raw_row(price_avg_raw=10, trade_datetime_raw=dt.datetime(2024, 3, 1)),
            raw_row(price_avg_raw=12, trade_datetime_raw=dt.datetime(2024, 3, 2)),
            raw_row(price_avg_raw=15, trade_datetime_raw=dt.datetime(2024, 3, 31)),
        ],
    )
    w = Warehouse.from_raw(spark, raw)
    r = C.asof_change(w.metrics, "2024-03-01", "2024-03-31").collect()[0]
    assert float(r.price_30d) == 10.0 and r.change_30d_pct == 50.0 and r.price_90d is None


def test_empty_period_card(spark):
    w = wh_prices(spark, {"AAA": [10, 11]})
    r = C.card(w.metrics, w.calendar, w.instruments, "AAA", "2030-01-01", "2030-12-31").collect()
    assert len(r) == 1
    r = r[0]
    assert r.active_days_count == 0 and r.last_price is None and r.issuer_name is None


def test_null_volatility_tier_is_low(spark):
    w = wh_prices(spark, {"AAA": [10], "BBB": [10, 11, 13], "CCC": [10, 12, 11]})
    tiers = {r.ticker: r.risk_status for r in Q.tiers(w.summary).collect()}
    assert tiers["AAA"] == "low"


def test_price_index(spark):
    w = wh_prices(spark, {"A": [10, "skip", 20], "B": ["skip", 5, "skip"]})
    h = P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31")
    idx = {(r.trade_date, r.ticker): r.price_index for r in P.price_index(h, ["A", "B"]).collect()}
    d0, d1, d2 = (day(i).date() for i in range(3))
    assert [idx[(d, "A")] for d in (d0, d1, d2)] == [100.0, 100.0, 200.0]
    assert [idx[(d, "B")] for d in (d0, d1, d2)] == [None, 100.0, 100.0]


def test_price_index_base_zero(spark):
    w = wh_prices(spark, {"A": [10, 11], "B": [0, 5]})
    h = P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31")
    rows = [r for r in P.price_index(h, ["A", "B"]).collect() if r.ticker == "B"]
    assert rows and all(r.price_index is None for r in rows)


def test_correlation_constant_series_and_missing_ticker(spark):
    # returns of A: 10%, 10%, 10% (constant); B: varying; C: a single row (no return)
    w = wh_prices(spark, {"A": [100, 110, 121, 133.1], "B": [100, 101, 103, 106], "C": [5]})
    h = P.compare_history(w.metrics, ["A", "B", "C"], "2024-01-01", "2024-01-31")
    c = {(r.ticker_a, r.ticker_b): r.correlation for r in P.correlation(h, ["A", "B", "C"]).collect()}
    assert set(c) == {("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")}
    assert c[("B", "B")] == 1.0 and c[("A", "B")] is None


def test_correlation_matches_pearson(spark):
    w = wh_prices(spark, {"A": [10, 11, 10.5, 12, 11.8], "B": [20, 19, 21, 20.5, 22]})
    h = P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31")
    got = {(r.ticker_a, r.ticker_b): r.correlation for r in P.correlation(h, ["A", "B"]).collect()}
    m = {t: [r.daily_return_pct for r in metrics_list(w, t)][1:] for t in "AB"}
    xa, xb = m["A"], m["B"]
    ma, mb = sum(xa) / len(xa), sum(xb) / len(xb)
    cov = sum((a - ma) * (b - mb) for a, b in zip(xa, xb))
    ref = cov / math.sqrt(sum((a - ma) ** 2 for a in xa) * sum((b - mb) ** 2 for b in xb))
    assert abs(got[("A", "B")] - round(ref, 3)) < 1e-9
    assert got[("A", "B")] == got[("B", "A")]


def test_ticker_filter_is_pushed_below_the_lag_window(spark):
    w = wh_prices(spark, {"A": [10, 11], "B": [5, 6]})
    plan = Q.period_rows(w.metrics, "2024-01-01", "2024-01-31", ["A"])._jdf.queryExecution().optimizedPlan().toString()
    window_at = plan.index("Window")
    # the ticker predicate appears below (after, in the tree string) the Window node
    assert "isin" in plan[window_at:] or "IN (A)" in plan[window_at:] or "= A)" in plan[window_at:]


def test_no_cartesian_products_in_queries(spark):
    w = wh_prices(spark, {"A": [10, 11, 12], "B": [5, 6, 7]})
    dfs = [
        Q.tiers(w.summary),
        Q.ranked_summary(w.summary),
        Q.period_stats(w.metrics, w.calendar, "2024-01-01", "2024-01-31"),
        C.card_kpis(w.metrics, w.calendar, w.instruments, "2024-01-01", "2024-01-31"),
        P.correlation(P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31"), ["A", "B"]),
    ]
    for df in dfs:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_ranked_summary_matches_global_windows(spark):
    w = wh_prices(spark, {t: [10, 10 + i, 10 + 2 * i] for i, t in enumerate("ABCDEFG")})
    r = Q.ranked_summary(w.summary, top=5).collect()
    s = sorted(w.summary.collect(), key=lambda x: (-(x.avg_turnover_value or -1e300), x.ticker))
    n = len(s)
    pos = {x.ticker: i + 1 for i, x in enumerate(s)}
    q, rem = divmod(n, 3)

    def ntile(p):
        big = rem * (q + 1)
        return (p - 1) // (q + 1) + 1 if p <= big else rem + (p - big - 1) // q + 1

    for row in r:
        assert row.liquidity_group == ntile(pos[row.ticker])
    assert [row.return_rank for row in r] == sorted(row.return_rank for row in r)


def test_screen_predicates_and_rounding(spark):
    w = wh_prices(spark, {"A": [10, 10.123456, 10.5], "B": [10, 9, 8]})
    stats = Q.period_stats(w.metrics, w.calendar, "2024-01-01", "2024-01-31")
    res = Q.screen(stats, Q.ScreenFilter(min_return_pct=0.0)).collect()
    assert [r.ticker for r in res] == ["A"]
    assert res[0].return_pct_period == 5.0 and res[0].last_price == 10.5
    head = Q.screen_headline(Q.screen(stats, Q.ScreenFilter(min_return_pct=1000.0))).collect()[0]
    assert (head.result_count, head.mean_return_pct) == (0, 0.0)


def test_anomaly_search_page(spark):
    w = Warehouse.from_raw(spark, make_raw(spark, _spike_rows([100, 100, 250, 100, 100, 900], "turnover_value_raw")))
    found = A.search_anomalies(w.anomalies, "2024-01-01", "2024-01-31", "AAA", ["turnover_spike"], 200.0)
    assert [r.trade_date for r in found.collect()] == [day(5).date()]
    h = A.anomaly_headline(found).collect()[0]
    assert h.anomalies_count == 1 and h.tickers_count == 1
    none = A.anomaly_headline(A.search_anomalies(w.anomalies, "2030-01-01", "2030-01-31")).collect()[0]
    assert (none.anomalies_count, none.max_abs_value_pct) == (0, 0.0)


def test_all_screen_predicates(spark):
    w = wh_prices(spark, {"A": [10, 11, 12], "B": [10, 9, 8], "C": [10, 10.5, 10.2]})
    stats = Q.period_stats(w.metrics, w.calendar, "2024-01-01", "2024-01-31")
    rows = {r.ticker: r for r in stats.collect()}

    def names(flt):
        return sorted(r.ticker for r in Q.screen(stats, flt).collect())

    assert names(Q.ScreenFilter(min_avg_turnover_value=100.0)) == ["A", "B", "C"]
    assert names(Q.ScreenFilter(min_avg_turnover_value=100.01)) == []
    assert names(Q.ScreenFilter(min_avg_deals_count=1.0)) == ["A", "B", "C"]
    assert names(Q.ScreenFilter(min_active_days_share_pct=100.0)) == ["A", "B", "C"]
    dd_b = abs(rows["B"].max_drawdown_pct)
    assert names(Q.ScreenFilter(max_abs_drawdown_pct=dd_b - 0.01)) == ["A", "C"]
    assert names(Q.ScreenFilter(max_volatility_pct=rows["A"].volatility_pct)) == sorted(
        t for t, r in rows.items() if r.volatility_pct <= rows["A"].volatility_pct
    )


def test_summary_refresh_only_when_saved(spark):
    w = wh_prices(spark, {"A": [10, 11]})
    table = "tl_summary_refresh_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    assert M.refresh_summary(spark, w.metrics, table) is False  # informational no-op
    M.save_summary(w.summary, table, as_table=True)
    w2 = wh_prices(spark, {"A": [10, 11], "B": [5, 6]})
    assert M.refresh_summary(spark, w2.metrics, table) is True
    assert spark.table(table).count() == 2
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_price_index_wide_layout(spark):
    w = wh_prices(spark, {"A": [10, "skip", 20], "B": ["skip", 5, "skip"]})
    h = P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31")
    wide = P.price_index_wide(P.price_index(h, ["A", "B"]), ["A", "B"]).collect()
    assert [(r.A, r.B) for r in wide] == [(100.0, None), (100.0, 100.0), (200.0, 100.0)]


def test_price_index_drops_all_null_dates(spark):
    # d0: A not yet priced, B's base is 0 -> every ticker NULL -> the date is dropped
    w = wh_prices(spark, {"A": ["skip", 10, 15], "B": [0, 5, 6]})
    h = P.compare_history(w.metrics, ["A", "B"], "2024-01-01", "2024-01-31")
    rows = P.price_index(h, ["A", "B"]).collect()
    d1, d2 = day(1).date(), day(2).date()
    assert sorted({r.trade_date for r in rows}) == [d1, d2]
    assert {(r.trade_date, r.ticker): r.price_index for r in rows}[(d2, "A")] == 150.0
    only_zero = P.compare_history(w.metrics, ["B"], "2024-01-01", "2024-01-31")
    assert P.price_index(only_zero, ["B"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_thresholds_equal_the_exact_percentile(spark, n):
    rng = random.Random(n)
    values = [(rng.choice([None, 0.0, rng.random()]), rng.random()) for _ in range(n)]
    s = spark.createDataFrame(values, "avg_turnover_value double, volatility_pct double")
    want = s.agg(*[F.percentile(c, p) for c in ("avg_turnover_value", "volatility_pct") for p in (0.33, 0.67)]).first()
    for a, b in zip(Q.thresholds(s).first(), want):
        assert a == b if b is None else a == pytest.approx(b, rel=1e-12)


def test_thresholds_from_brackets(spark, monkeypatch):
    monkeypatch.setattr(Q, "BRACKET", 100)  # so that 2000 rows are many
    rng = random.Random(5)
    values = [(round(rng.random(), 2) if k % 3 else 0.5, rng.expovariate(1)) for k in range(2000)]
    s = spark.createDataFrame(values, "avg_turnover_value double, volatility_pct double")
    want = s.agg(*[F.percentile(c, p) for c in ("avg_turnover_value", "volatility_pct") for p in (0.33, 0.67)]).first()
    assert tuple(Q.thresholds(s).first()) == pytest.approx(tuple(want), rel=1e-12)


def test_card_of_an_unknown_ticker_is_one_empty_row(spark):
    w = Warehouse.from_raw(spark, make_raw(spark, [raw_row()]))
    rows = C.card(w.metrics, w.calendar, w.instruments, "NOBODY", "2024-01-01", "2024-12-31").collect()
    assert [(r.ticker, r.last_price, r.active_days_count) for r in rows] == [("NOBODY", None, 0)]


def test_asof_prices_of_many_cut_offs(spark):
    w = wh_prices(spark, {"A": [10, 11, 12], "B": [5]})
    days = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=k)) for t in ("A", "B", "C") for k in range(-3, 9)]
    cutoffs = spark.createDataFrame(days + days[:2], "ticker string, cutoff date")
    got = sorted(((r.ticker, r.cutoff, r.asof_date, r.price) for r in C.asof_prices(w.metrics, cutoffs).collect()), key=str)
    rows = [(r.ticker, r.trade_date, r.price_avg_weighted) for r in w.metrics.collect()]
    want = []
    for t, c in days + days[:2]:
        last = max(((d, p) for u, d, p in rows if u == t and d <= c), default=(None, None))
        want.append((t, c, *last))
    assert got == sorted(want, key=str)
