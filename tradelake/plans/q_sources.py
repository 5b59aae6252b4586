"""Registered queries: raw-text cleaning and coercion, simulator preparation steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import clean_text, coerce_decimal, coerce_int, coerce_timestamp, round_half_up
from ..operators import prep as P
from ..operators.loading import read_state, read_summary
from ..schemas import HEADER_MAP, RAW_DECIMAL_COLUMNS
from ..session import ensure_checkpoint_dir
from ..sources import archives as A
from ..sources import testdata
from ..sources.export import write_archives
from ..streaming.ingest import ingest_stream
from . import oracle_sql as S
from .q_core import FACT_OUT, FACT_SQL, SUMMARY_SQL, summary_out
from .registry import out, register, wh


def _clean_sql(x: str) -> str:
    return f"NULLIF(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


MEMO_SQL = (
    "CASE WHEN l_linenumber = 4 THEN ' ' || chr(9) || ' ' "
    "ELSE chr(9) || l_returnflag || chr(10) || ' ' || l_linestatus || ' ' END"
)


@register(
    "clean_text",
    S.with_(S.raw_cte())
    + f"SELECT {_clean_sql('ticker_raw')} AS ticker, {_clean_sql('issuer_name_raw')} AS issuer_name, "
    f"{_clean_sql('currency_code_raw')} AS currency_code, {_clean_sql(MEMO_SQL)} AS memo, COUNT(*) AS n "
    "FROM raw GROUP BY ALL",
)
def q_clean_text(spark, sf_dir):
    r = testdata.raw_trades(spark, sf_dir, with_source_order=True)
    memo = F.when(F.col("l_linenumber") == 4, F.lit(" \t ")).otherwise(
        F.concat(F.lit("\t"), "l_returnflag", F.lit("\n "), "l_linestatus", F.lit(" "))
    )
    c = r.select(
        clean_text("ticker_raw").alias("ticker"),
        clean_text("issuer_name_raw").alias("issuer_name"),
        clean_text("currency_code_raw").alias("currency_code"),
        clean_text(memo).alias("memo"),
    )
    return c.groupBy("ticker", "issuer_name", "currency_code", "memo").agg(F.count(F.lit(1)).alias("n"))


def _num_sql(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


PRICE_TEXT_SQL = "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END"
DEALS_TEXT_SQL = (
    "(CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END) || CAST(l_linenumber AS VARCHAR) || '.' || "
    "CAST(l_suppkey % 10 AS VARCHAR)"
)
QTY_TEXT_SQL = "CASE WHEN l_linenumber = 6 THEN 'NaN' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@register(
    "coerce_numeric",
    f"SELECT l_orderkey, l_linenumber, CAST(CAST({_num_sql(PRICE_TEXT_SQL)} AS DECIMAL(18,6)) AS DOUBLE) AS price_avg_raw, "
    f"CAST(trunc({_num_sql(DEALS_TEXT_SQL)}) AS INTEGER) AS deals_count_raw, "
    f"CAST(CAST({_num_sql(QTY_TEXT_SQL)} AS DECIMAL(20,6)) AS DOUBLE) AS turnover_qty_raw FROM lineitem",
)
def q_coerce_numeric(spark, sf_dir):
    li = testdata.table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    )
    deals = F.concat(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("-")).otherwise(F.lit("")),
        F.col("l_linenumber").cast("string"),
        F.lit("."),
        (F.col("l_suppkey") % 10).cast("string"),
    )
    qty = F.when(F.col("l_linenumber") == 6, F.lit("NaN")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        coerce_decimal(price, 18, 6).cast("double").alias("price_avg_raw"),
        coerce_int(deals).alias("deals_count_raw"),
        coerce_decimal(qty, 20, 6).cast("double").alias("turnover_qty_raw"),
    )


@register(
    "coerce_timestamp",
    "SELECT l_orderkey, l_linenumber, TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'not a date' "
    "ELSE CAST(l_shipdate AS VARCHAR) END AS TIMESTAMP) AS trade_datetime_raw FROM lineitem",
)
def q_coerce_timestamp(spark, sf_dir):
    li = testdata.table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 3, F.lit("not a date")).otherwise(F.col("l_shipdate").cast("string"))
    return li.select("l_orderkey", "l_linenumber", coerce_timestamp(text).alias("trade_datetime_raw"))


MONTHLY_SQL = (
    "mp AS (SELECT last_day(trade_date) AS trade_date, issuer_name, "
    "CAST(SUM(price_avg_weighted) AS DOUBLE) / COUNT(price_avg_weighted) AS price FROM metrics GROUP BY ALL)"
)


def _monthly(spark, sf_dir):
    w = wh(spark, sf_dir)
    return P.monthly_prices(w.facts, w.instruments, w.issuers)


@register(
    "unpivot_prices",
    S.base(MONTHLY_SQL) + "SELECT trade_date, issuer_name, price FROM mp WHERE price IS NOT NULL AND price > 0",
)
def q_unpivot_prices(spark, sf_dir):
    return P.positive_prices(_monthly(spark, sf_dir))


@register(
    "activity_profile",
    S.base(
        MONTHLY_SQL,
        "months AS (SELECT COUNT(DISTINCT trade_date) AS n FROM mp)",
    )
    + "SELECT issuer_name, CAST(COUNT(*) FILTER (WHERE price > 0) AS DOUBLE) / (SELECT n FROM months) AS nonzero_ratio, "
    f"{S.rnd('COALESCE(quantile_cont(price, 0.5) FILTER (WHERE price > 0), 0.0)', 4)} AS price_median "
    "FROM mp GROUP BY issuer_name",
)
def q_activity_profile(spark, sf_dir):
    a = P.activity_profile(_monthly(spark, sf_dir))
    return a.withColumn("price_median", round_half_up("price_median", 4))


@register(
    "business_days",
    S.with_(S.raw_cte(), S.calendar_cte())
    + "SELECT month_start, CAST(d AS DATE) AS trade_date FROM (SELECT DISTINCT CAST(date_trunc('month', trade_date) AS DATE) "
    "AS month_start FROM trading_calendar) m, LATERAL (SELECT unnest(generate_series(CAST(month_start AS TIMESTAMP), "
    "CAST(last_day(month_start) AS TIMESTAMP), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6",
)
def q_business_days(spark, sf_dir):
    cal = wh(spark, sf_dir).calendar
    months = cal.select(F.trunc("trade_date", "month").alias("month_start")).distinct()
    return P.business_days(months)


# --- S3, S5, S7, S8, S10: archive cells --------------------------------------------------------
# Scenario: the raw rows as text cells.  Archives of odd months have their columns in another order,
# those of March lack the term, and every fifth deal line is a blank row.
CELL_ORDER = [
    "ticker_raw", "issuer_name_raw", "currency_code_raw", "price_min_raw", "price_avg_raw", "price_aux_raw", "yield_min_raw",
    "yield_max_raw", "yield_avg_raw", "turnover_value_raw", "turnover_qty_raw", "deals_count_raw", "term_days_raw", "trade_datetime_raw",
]
OTHER_ORDER = [c for c in reversed(CELL_ORDER) if c != "price_aux_raw"]
OTHER_ORDER.insert(5, "price_aux_raw")  # taken by position


def _cells(spark, sf_dir):
    """(cells, headers) of the scenario."""
    raw = testdata.raw_trades(spark, sf_dir)
    text = {by: F.col(by).cast("string") for by in CELL_ORDER}
    odd, march = F.col("file_key") % 2 == 1, F.col("file_key") % 100 == 3
    row = F.when(odd, F.array(*[text[c] for c in OTHER_ORDER])).otherwise(F.array(*[text[c] for c in CELL_ORDER]))
    blank = F.transform(row, lambda x: F.lit(None).cast("string"))
    cells = raw.select("file_key", "file_name", F.when(F.col("deals_count_raw") == 5, blank).otherwise(row).alias("cells"))
    titles = {raw_name: title for title, raw_name in HEADER_MAP.items()} | {"price_aux_raw": ""}
    named = lambda order, gone=(): F.array(*[F.lit("?" if c in gone else f" {titles[c]}") for c in order])
    header = F.when(march, named(OTHER_ORDER, ("term_days_raw",))).when(odd, named(OTHER_ORDER)).otherwise(named(CELL_ORDER))
    return cells, raw.select("file_key", "file_name").distinct().select("file_name", header.alias("header"))


@register(
    "map_headers",
    S.with_(S.raw_cte())
    + "SELECT file_name, count(*) AS n, count(CASE WHEN deals_count_raw <> 5 THEN 1 END) AS filled, "
    "CASE WHEN file_key % 100 = 3 THEN 'expected columns not found: term_days_raw' END AS load_error, "
    "CAST(sum(CASE WHEN deals_count_raw <> 5 THEN turnover_value_raw END) AS DOUBLE) AS turnover, "
    "CAST(sum(CASE WHEN deals_count_raw <> 5 THEN price_aux_raw END) AS DOUBLE) AS aux FROM raw GROUP BY file_key, file_name",
)
def q_map_headers(spark, sf_dir):
    mapped = A.map_headers(*_cells(spark, sf_dir), "file_name")
    total = lambda c, t: F.sum(F.col(c).cast(t)).cast("double")
    return mapped.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("ticker_raw").alias("filled"), F.first("load_error").alias("load_error"),
        total("turnover_value_raw", "decimal(20,2)").alias("turnover"), total("price_aux_raw", "decimal(18,6)").alias("aux"),
    )


def _typed(spark, sf_dir, **options):
    return A.type_raw(A.map_headers(*_cells(spark, sf_dir), "file_name"), **options)


@register(
    "constant_segment",
    S.with_(S.raw_cte()) + "SELECT file_key, 'bonds' AS market_segment_raw, count(*) AS n FROM raw GROUP BY file_key",
)
def q_constant_segment(spark, sf_dir):
    typed = _typed(spark, sf_dir, market_segment=" bonds ")
    return typed.groupBy("file_key", "market_segment_raw").agg(F.count(F.lit(1)).alias("n"))


@register(
    "drop_blank_rows",
    S.with_(S.raw_cte())
    + "SELECT file_key, count(*) AS n, CAST(sum(CASE WHEN deals_count_raw <> 5 THEN deals_count_raw END) AS BIGINT) AS deals "
    "FROM raw WHERE deals_count_raw <> 5 OR file_key % 100 = 3 GROUP BY file_key",
)
def q_drop_blank_rows(spark, sf_dir):
    """A blank row of a file without an expected column stays: it carries the file's error."""
    typed = _typed(spark, sf_dir, drop_blank=True)
    return typed.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"), F.sum("deals_count_raw").alias("deals"))


@register(
    "raw_sink",
    S.with_(S.raw_cte())
    + "SELECT file_key, count(*) AS n, CAST(sum(CASE WHEN deals_count_raw <> 5 THEN turnover_qty_raw END) AS DOUBLE) AS qty, "
    "min(CASE WHEN deals_count_raw <> 5 THEN trade_datetime_raw END) AS first_time FROM raw GROUP BY file_key",
)
def q_raw_sink(spark, sf_dir):
    """The typed rows written with one folder for each archive, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/raw-sink-{uuid.uuid4().hex}"
    A.write_raw(_typed(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("file_key").cast("long").alias("file_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("turnover_qty_raw").cast("double").alias("qty"), F.min("trade_datetime_raw").alias("first_time")
    )


# --- S1, S2, CSV, L5: through archive files -----------------------------------------------------
# The archives of the test tables are written as files first; the queries list, read and load them.
def _archives(spark, sf_dir, fmt: str, file_by: str = "ship") -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    raw = testdata.raw_trades(spark, sf_dir, file_by, with_source_order=True, dealt=True)
    write_archives(raw, folder, fmt, testdata.SOURCE_ORDER, dealt=True).agg(F.sum("rows_count")).first()
    return folder


def _named(fmt: str) -> str:
    return f"replace(file_name, '.xlsx', '.{fmt}')"


@register(
    "archive_listing",
    S.with_(S.raw_cte(), f"f AS (SELECT DISTINCT {_named('csv')} AS file_name FROM raw)")
    + "SELECT file_name, row_number() OVER (ORDER BY file_name) AS file_order FROM f",
)
def q_archive_listing(spark, sf_dir):
    return A.list_archives(spark, _archives(spark, sf_dir, "csv"), "*.csv").select("file_name", "file_order")


def _rows_sql(fmt: str) -> str:
    texts = ", ".join(f"{_clean_sql(c)} AS {c}" for c in ("ticker_raw", "issuer_name_raw", "currency_code_raw"))
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in RAW_DECIMAL_COLUMNS)
    return S.with_(S.raw_cte()) + (
        f"SELECT {_named(fmt)} AS file_name, CAST(row_number() OVER (PARTITION BY file_key ORDER BY {', '.join(testdata.SOURCE_ORDER)}) AS INTEGER) "
        f"AS row_num, {texts}, {numbers}, deals_count_raw, term_days_raw, trade_datetime_raw, market_segment_raw FROM raw"
    )


def _archive_rows(cells):
    rows = A.number_rows(A.type_raw(cells))
    return out(rows.select("file_name", "row_num", *A.RAW_COLUMNS))


@register("csv_archive_rows", _rows_sql("csv"))
def q_csv_archive_rows(spark, sf_dir):
    files = A.list_archives(spark, _archives(spark, sf_dir, "csv"), "*.csv")
    return _archive_rows(A.read_csv_archives(spark, files))


@register("workbook_rows", _rows_sql("xlsx"))
def q_workbook_rows(spark, sf_dir):
    files = A.list_archives(spark, _archives(spark, sf_dir, "xlsx"))
    return _archive_rows(A.read_workbooks(spark, files))


def _streamed(spark, sf_dir) -> str:
    """Archives by order month, so that many days come in several archives; two micro-batches."""
    root = f"{ensure_checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"
    folder = _archives(spark, sf_dir, "csv", "order")
    query = ingest_stream(
        spark, folder, f"{root}/state", f"{root}/checkpoint", "*.csv", fmt="csv", max_archives_per_trigger=45, gate_options={"min_year": 1900}
    )
    query.awaitTermination()
    return f"{root}/state"


_LATEST_FILE_SQL = S.base(file_by="order")


@register(
    "stream_facts",
    _LATEST_FILE_SQL + f"SELECT {', '.join(c for c in FACT_SQL.split(', ') if 'file' not in c)} FROM facts",
)
def q_stream_facts(spark, sf_dir):
    """Facts of a stream over all archives: of a day in several archives, the greatest name's."""
    return out(read_state(spark, _streamed(spark, sf_dir)).facts, *[c for c in FACT_OUT if "file" not in c])


@register("stream_summary", S.base(S.summary_cte(), file_by="order") + f"SELECT {SUMMARY_SQL} FROM summary")
def q_stream_summary(spark, sf_dir):
    """The stored summary after a stream: refreshed with every micro-batch."""
    return summary_out(read_summary(spark, _streamed(spark, sf_dir)))
