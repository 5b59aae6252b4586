"""Hand-made edge rows for normalisation (issuers, instruments, calendar, daily facts)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tradelake.operators import normalize as N
from tradelake.plans.warehouse import Warehouse

from .conftest import make_raw, raw_row


def facts_of(spark, rows):
    return {(r.ticker, r.trade_date): r for r in N.build_daily_stats(make_raw(spark, rows)).collect()}


def one(spark, rows):
    f = facts_of(spark, rows)
    assert len(f) == 1
    return next(iter(f.values()))


def test_weighted_price(spark):
    r = one(spark, [raw_row(price_avg_raw=10, turnover_qty_raw=1), raw_row(price_avg_raw=20, turnover_qty_raw=3)])
    assert r.price_avg_weighted == Decimal("17.5")


def test_no_positive_quantity_falls_back_to_mean(spark):
    r = one(spark, [raw_row(price_avg_raw=10, turnover_qty_raw=0), raw_row(price_avg_raw=20, turnover_qty_raw=None)])
    assert r.price_avg_weighted == Decimal("15")


def test_null_price_beside_good_row(spark):
    r = one(spark, [raw_row(price_avg_raw=None, turnover_qty_raw=5), raw_row(price_avg_raw=20, turnover_qty_raw=2)])
    assert r.price_avg_weighted == Decimal("20")


def test_negative_quantity_quirk(spark):
    # numerator includes -10, weight only 2: (-10 + 40) / 2
    r = one(spark, [raw_row(price_avg_raw=10, turnover_qty_raw=-1), raw_row(price_avg_raw=20, turnover_qty_raw=2)])
    assert r.price_avg_weighted == Decimal("15")


def test_weighted_average_rounds_half_up_to_six_places(spark):
    # (1*1 + 2*2 + ... ) / W with a non-terminating quotient: 10/3 -> 3.333333
    r = one(spark, [raw_row(price_avg_raw=1, turnover_qty_raw=1), raw_row(price_avg_raw=4.5, turnover_qty_raw=2)])
    assert r.price_avg_weighted == Decimal("3.333333")
    r = one(spark, [raw_row(price_avg_raw=2, turnover_qty_raw=1), raw_row(price_avg_raw=3.000001, turnover_qty_raw=1)])
    assert r.price_avg_weighted == Decimal("2.500001")  # 2.5000005 -> half up


def test_all_turnover_null_is_zero(spark):
    r = one(spark, [raw_row(turnover_value_raw=None, deals_count_raw=None), raw_row(turnover_value_raw=None, deals_count_raw=None)])
    assert r.turnover_value == Decimal("0") and r.deals_count == 0


def test_blank_ticker_or_issuer_gives_no_fact_but_a_calendar_day(spark):
    raw = make_raw(
        spark,
        [
            raw_row(ticker_raw="  ", trade_datetime_raw=dt.datetime(2024, 2, 1)),
            raw_row(issuer_name_raw=" ", trade_datetime_raw=dt.datetime(2024, 2, 2)),
        ],
    )
    assert N.build_daily_stats(raw).count() == 0
    days = {r.trade_date for r in N.build_calendar(raw).collect()}
    assert days == {dt.date(2024, 2, 1), dt.date(2024, 2, 2)}


def test_blank_currency_defaults(spark):
    ins = N.build_instruments(make_raw(spark, [raw_row(currency_code_raw="  ")])).collect()
    assert ins[0].currency_code == "BYN"


def test_term_days_keeps_latest_non_null(spark):
    raw = make_raw(spark, [raw_row(file_key=1, term_days_raw=30), raw_row(file_key=2, term_days_raw=None)])
    assert N.build_instruments(raw).collect()[0].term_days == 30


def test_instrument_takes_latest_file_issuer(spark):
    raw = make_raw(
        spark,
        [raw_row(file_key=1, issuer_name_raw="Old", currency_code_raw="EUR"), raw_row(file_key=2, issuer_name_raw="New")],
    )
    w = Warehouse.from_raw(spark, raw)
    r = w.instruments.join(w.issuers, "issuer_id").collect()[0]
    assert (r.issuer_name, r.currency_code) == ("New", "USD")
    assert {x.issuer_name for x in w.issuers.collect()} == {"Old", "New"}


def test_two_currencies_in_one_file_is_a_conflict(spark):
    raw = make_raw(spark, [raw_row(file_key=1, currency_code_raw="USD"), raw_row(file_key=1, currency_code_raw="EUR")])
    c = N.instrument_conflicts(raw).collect()
    assert [(r.file_key, r.ticker, r.variants) for r in c] == [(1, "AAA", 2)]


def test_same_day_in_two_files_overwrites(spark):
    r = one(spark, [raw_row(file_key=1, turnover_value_raw=100), raw_row(file_key=2, turnover_value_raw=40)])
    assert r.turnover_value == Decimal("40") and r.file_key == 2


def test_upsert_against_existing_facts(spark):
    old = N.build_daily_stats(make_raw(spark, [raw_row(file_key=1, turnover_value_raw=100), raw_row(file_key=1, trade_datetime_raw=dt.datetime(2024, 1, 3))]))
    new = N.daily_parts(make_raw(spark, [raw_row(file_key=2, turnover_value_raw=40)]))
    merged = {r.trade_date: r for r in N.daily_stats_from_parts(new, old).collect()}
    assert merged[dt.date(2024, 1, 2)].turnover_value == Decimal("40")
    assert merged[dt.date(2024, 1, 3)].file_key == 1


def test_described_facts_take_the_latest_files_descriptors(spark):
    raw = make_raw(
        spark,
        [
            raw_row(file_key=1, issuer_name_raw="Old", currency_code_raw="EUR"),
            raw_row(file_key=2, issuer_name_raw="New", trade_datetime_raw=dt.datetime(2024, 1, 5)),
            raw_row(file_key=3, issuer_name_raw="Newest", trade_datetime_raw=None),
        ],
    )
    w = Warehouse.from_raw(spark, raw)
    plain = {r.trade_date: (r.issuer_name, r.currency_code) for r in w.facts.join(w.instruments, "ticker").join(w.issuers, "issuer_id").collect()}
    own = {r.trade_date: (r.issuer_name, r.currency_code) for r in N.described_facts(w.parts).collect()}
    assert own == plain == {dt.date(2024, 1, 2): ("Newest", "USD"), dt.date(2024, 1, 5): ("Newest", "USD")}


def test_iso_week(spark):
    raw = make_raw(spark, [raw_row(trade_datetime_raw=dt.datetime(2024, 12, 30))])
    r = N.build_calendar(raw).collect()[0]
    assert (r.year_num, r.quarter_num, r.week_num) == (2024, 4, 1)


def test_trimming_tickers_and_issuers(spark):
    raw = make_raw(spark, [raw_row(ticker_raw="  AAA ", issuer_name_raw=" Issuer A  ")])
    f = N.build_daily_stats(raw).collect()[0]
    assert f.ticker == "AAA"
    assert N.build_issuers(raw).collect()[0].issuer_name == "Issuer A"


def test_default_segment_when_blank(spark):
    r = one(spark, [raw_row(market_segment_raw="  ")])
    assert r.market_segment == "shares"


def test_fact_aggregation_is_hash_based(spark):
    raw = make_raw(spark, [raw_row()])
    plan = N.described_facts(N.daily_parts(raw))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_existing_issuer_untouched(spark):
    existing = N.build_issuers(make_raw(spark, [raw_row(issuer_name_raw="Issuer A")]))
    both = N.build_issuers(make_raw(spark, [raw_row(issuer_name_raw="Issuer A"), raw_row(issuer_name_raw="B")]), existing)
    assert sorted(r.issuer_name for r in both.collect()) == ["B", "Issuer A"]
    assert both.where(F.col("issuer_name") == "Issuer A").count() == 1


def test_rows_are_dealt_out_before_they_are_grouped(spark):
    """Facts take one shuffle, of the raw rows by ticker and day: no map-side step holds and widens them."""
    plan = N.build_daily_stats(make_raw(spark, [raw_row()]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(ticker" in plan
    below = plan.split("Exchange", 1)[1]
    assert "HashAggregate" not in below


def test_instruments_from_rows_equal_those_from_parts(spark):
    raw = make_raw(
        spark,
        [raw_row(file_key=k, issuer_name_raw=f"I{k % 3}", term_days_raw=t, ticker_raw=f"T{k % 2}") for k, t in enumerate([5, None, 7, None, 3, None])],
    )
    rows, parts = (sorted(N.instruments_from_parts(p).collect()) for p in (N.cleaned_rows(raw), N.daily_parts(raw)))
    assert rows == parts and len(rows) == 2
