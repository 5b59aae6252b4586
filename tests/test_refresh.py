"""Incremental refresh of the stored summary against a full rebuild."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tradelake.operators import loading as L
from tradelake.operators import metrics as M
from tradelake.operators import refresh as R

from .conftest import make_raw, raw_row

START = dt.date(2024, 1, 1)


def archive(key, rows):
    """rows: (ticker, day number, price, turnover)."""
    made = []
    for ticker, day, price, turnover in rows:
        when = START + dt.timedelta(days=day)
        made.append(raw_row(
            key, ticker_raw=ticker, trade_datetime_raw=when, price_avg_raw=price, price_min_raw=price, price_aux_raw=price,
            turnover_value_raw=turnover, deals_count_raw=0 if not turnover else 3, issuer_name_raw=f"Issuer {ticker}",
        ))
    return made


def load(spark, root, key, rows, **options):
    raw = make_raw(spark, archive(key, rows))
    files = spark.createDataFrame([(key, f"f{key:03d}.xlsx", 1)], "file_key long, file_name string, file_order long")
    state, _ = L.load_batch(L.read_state(spark, root), raw, files, gate_options={"min_year": 1900}, **options)
    L.publish(state, root, summary=True)


def rounded(df):
    cols = [F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def rebuilt(spark, root):
    state = L.read_state(spark, root)
    return M.instrument_summary(M.daily_metrics(state.facts, state.instruments, state.issuers))


def random_rows(rng, tickers, days, n):
    return [
        (rng.choice(tickers), d, rng.choice([None, 0, *range(50, 150)]), rng.choice([0, 10, 500]))
        for d in {rng.choice(days) for _ in range(n)}
    ]


@pytest.mark.parametrize("seed", range(2))
def test_random_loads_equal_a_full_rebuild(spark, seed):
    rng, root = random.Random(seed), tempfile.mkdtemp(prefix="tl-refresh-")
    tickers = ["A", "B", "C", "D"]
    for key in range(1, 5):
        days = range(200) if key % 2 else range(200 + 20 * key, 220 + 20 * key)  # old days, new days
        load(spark, root, key, random_rows(rng, tickers[: 1 + (key + seed) % 4], days, 30))
        assert rounded(L.read_summary(spark, root)) == rounded(rebuilt(spark, root))


def test_versions_are_merged(spark, monkeypatch):
    monkeypatch.setattr(L, "SUMMARY_VERSIONS", 1)
    rng, root = random.Random(5), tempfile.mkdtemp(prefix="tl-refresh-")
    for key in range(1, 4):
        load(spark, root, key, random_rows(rng, ["A", "B"], range(100), 10))
        assert len(L.read_pointer(spark, root)["summary"]["versions"]) <= 1
    assert rounded(L.read_summary(spark, root)) == rounded(rebuilt(spark, root))


def test_rows_read_are_those_behind_the_change(spark):
    facts = spark.createDataFrame(
        [(t, START + dt.timedelta(days=d), 1, 1, 1) for t in "ABCDE" for d in range(366)],
        "ticker string, trade_date date, price_avg_weighted int, turnover_value int, deals_count int",
    )
    changed = spark.createDataFrame([("B", dt.date(2024, 12, 5)), ("C", dt.date(2024, 11, 30))], "ticker string, first_day date")
    got = {(r.ticker, r["min"], r["n"]) for r in R.suffix(facts, changed).groupBy("ticker").agg(
        F.min("trade_date").alias("min"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("B", dt.date(2024, 12, 1), 31), ("C", dt.date(2024, 11, 1), 61)}


def test_descriptors_and_a_load_without_changes(spark):
    root = tempfile.mkdtemp(prefix="tl-refresh-")
    load(spark, root, 1, [("A", 3, 10, 5), ("A", 40, 20, 5)])
    before = rounded(L.read_summary(spark, root))
    load(spark, root, 2, [(None, 60, 10, 5)])  # no ticker: no fact
    assert rounded(L.read_summary(spark, root)) == before
    load(spark, root, 3, [("A", 2, 40, 5)], replace=True)  # an earlier first day moves everything
    assert rounded(L.read_summary(spark, root)) == rounded(rebuilt(spark, root)) != before
