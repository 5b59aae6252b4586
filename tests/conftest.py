from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tradelake.schemas import RAW_PAYLOAD_SCHEMA  # noqa: E402
from tradelake.session import ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .appName("tradelake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tl-warehouse-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


RAW_FIELDS = [f.name for f in RAW_PAYLOAD_SCHEMA.fields]
DEC = {f.name for f in RAW_PAYLOAD_SCHEMA.fields if f.dataType.typeName() == "decimal"}


def raw_row(file_key=1, file_name=None, **kw):
    """One raw archive row with sensible defaults; decimals/timestamps given as plain values."""
    base = {
        "ticker_raw": "AAA",
        "issuer_name_raw": "Issuer A",
        "currency_code_raw": "USD",
        "price_min_raw": 10,
        "price_avg_raw": 10,
        "price_aux_raw": 10,
        "yield_min_raw": None,
        "yield_max_raw": None,
        "yield_avg_raw": None,
        "turnover_value_raw": 100,
        "turnover_qty_raw": 10,
        "deals_count_raw": 1,
        "term_days_raw": None,
        "trade_datetime_raw": dt.datetime(2024, 1, 2),
        "market_segment_raw": "shares",
    }
    base.update(kw)
    for k in list(base):
        if k in DEC and base[k] is not None:
            base[k] = Decimal(str(base[k]))
        if k == "trade_datetime_raw" and isinstance(base[k], dt.date) and not isinstance(base[k], dt.datetime):
            base[k] = dt.datetime.combine(base[k], dt.time())
    return (file_key, file_name or f"f{file_key:03d}.xlsx", *[base[f] for f in RAW_FIELDS])


def make_raw(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("file_key", T.LongType()), T.StructField("file_name", T.StringType())]
        + RAW_PAYLOAD_SCHEMA.fields
    )
    return spark.createDataFrame(rows, schema)


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
