"""Quantile sketches against exact percentiles."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tradelake.operators import screening as Q
from tradelake.operators import sketches as K


def test_thresholds_within_the_stated_rank_error(spark):
    rng = random.Random(1)
    rows = [(rng.lognormvariate(3, 2) if i % 11 else None, rng.gauss(0, 5) if i % 7 else 1.0) for i in range(30_000)]
    summary = spark.createDataFrame(rows, "avg_turnover_value double, volatility_pct double").repartition(6)
    assert K.approx_thresholds(summary).columns == Q.thresholds(summary).columns
    found = K.quantiles(K.sketch_values(summary, ["avg_turnover_value", "volatility_pct"]), 0.33, 0.67)
    errors = K.rank_errors(summary, found).collect()
    assert len(errors) == 4 and all(e.rank_error <= K.RANK_ERROR for e in errors)
    exact, near = Q.thresholds(summary).first(), K.approx_thresholds(summary).first()
    assert all(abs(a - b) < 0.15 * max(1.0, abs(a)) for a, b in zip(exact, near))


def test_stored_months_answer_any_span(spark, tmp_path):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d) + rng.random(), rng.gauss(d % 3, 1)) for d in range(366) for _ in range(60)]
    daily = spark.createDataFrame(rows, "trade_date date, turnover_value double, daily_return_pct double")
    columns = ["turnover_value", "daily_return_pct"]
    K.month_sketches(daily, columns).write.partitionBy("month").parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    for first, last in ((202402, 202402), (202403, 202409), (202401, 202412)):
        span = daily.where((F.year("trade_date") * 100 + F.month("trade_date")).between(first, last))
        found = K.period_quantiles(stored, first, last, 0.1, 0.5, 0.9)
        errors = K.rank_errors(span, found).collect()
        assert len(errors) == 6 and all(e.rank_error <= K.RANK_ERROR and e.n == span.count() for e in errors)


def test_empty_tables_and_null_columns(spark):
    none = spark.createDataFrame([], "avg_turnover_value double, volatility_pct double")
    assert tuple(K.approx_thresholds(none).first()) == (None,) * 4
    half = spark.createDataFrame([(1.0, None), (2.0, None)], "avg_turnover_value double, volatility_pct double")
    got = K.approx_thresholds(half).first()
    assert got.vol_p33 is None and got.turnover_p33 in (1.0, 2.0)
