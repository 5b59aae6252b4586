"""Registered queries: dimensions, upsert, registry and load decisions, manifest, row numbers,
and the data-quality suite."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import loading as L
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import quality as D
from ..operators.rownum import with_row_number
from ..schemas import DEFAULT_SOURCE_TYPE, LOAD_NOTE
from ..session import ensure_checkpoint_dir
from ..sources import testdata
from . import oracle_sql as S
from .q_core import ANOMALY_OUT, ANOMALY_SQL, FACT_OUT, FACT_SQL, SUMMARY_SQL, summary_out
from .registry import out, register, wh

LOADED_AT = dt.datetime(2026, 1, 31, 12, 0, 0)
PREVIOUS_LOAD_BEFORE = 199701  # scenario: archives before 1997 were loaded by an earlier run
REPLACED_FROM, REPLACED_TO = 199501, 199512  # scenario: the 1995 archives are reloaded
SRC_ORDER_SQL = ", ".join(testdata.SOURCE_ORDER)


def state(spark, sf_dir, file_by: str = "ship") -> L.ArchiveState:
    w = wh(spark, sf_dir, file_by, keep=False)
    registry = L.register_files(L.files_of(w.raw), w.raw, loaded_at=LOADED_AT)
    return L.ArchiveState(registry, w.raw, w.issuers, w.instruments, w.calendar, w.facts)


def _dirty_raw(raw):
    """Dirty-archive scenario: first lines are quoted in another currency, so a ticker gets two
    instrument tuples inside one file."""
    return raw.withColumn(
        "currency_code_raw",
        F.when(F.col("deals_count_raw") == 1, F.lit("EUR")).otherwise(F.col("currency_code_raw")),
    )


DIRTY_SQL = (
    "raw_d AS (SELECT * REPLACE (CASE WHEN deals_count_raw = 1 THEN 'EUR' ELSE currency_code_raw END "
    "AS currency_code_raw) FROM raw)"
)


# --- N1-N3, N5 --------------------------------------------------------------------------------
@register(
    "issuers",
    S.with_(S.raw_cte())
    + "SELECT DISTINCT NULLIF(trim(issuer_name_raw), '') AS issuer_name, TRUE AS is_active FROM raw "
    "WHERE NULLIF(trim(issuer_name_raw), '') IS NOT NULL",
)
def q_issuers(spark, sf_dir):
    return wh(spark, sf_dir).issuers.select("issuer_name", "is_active")


@register(
    "instruments",
    S.with_(S.raw_cte(), S.instruments_cte())
    + "SELECT ticker, issuer_name, currency_code, instrument_type, term_days, TRUE AS is_active FROM instruments",
)
def q_instruments(spark, sf_dir):
    w = wh(spark, sf_dir)
    return w.instruments.join(w.issuers.select("issuer_id", "issuer_name"), "issuer_id").select(
        "ticker", "issuer_name", "currency_code", "instrument_type", "term_days", "is_active"
    )


@register(
    "instrument_conflicts",
    S.with_(S.raw_cte(), DIRTY_SQL, S.instruments_cte("raw_d", "ins"))
    + "SELECT file_key, ticker, COUNT(*) AS variants FROM ins_t GROUP BY file_key, ticker HAVING COUNT(*) > 1",
)
def q_instrument_conflicts(spark, sf_dir):
    return N.instrument_conflicts(_dirty_raw(wh(spark, sf_dir).raw))


@register(
    "trading_calendar",
    S.with_(S.raw_cte())
    + "SELECT trade_date, CAST(year(trade_date) AS INTEGER) AS year_num, CAST(month(trade_date) AS INTEGER) AS month_num, "
    "CAST(quarter(trade_date) AS INTEGER) AS quarter_num, CAST(week(trade_date) AS INTEGER) AS week_num, "
    "TRUE AS is_trading_day FROM (SELECT DISTINCT CAST(trade_datetime_raw AS DATE) AS trade_date FROM raw "
    "WHERE trade_datetime_raw IS NOT NULL)",
)
def q_trading_calendar(spark, sf_dir):
    return wh(spark, sf_dir).calendar


@register("daily_stats_upsert", S.base(file_by="order") + f"SELECT {FACT_SQL} FROM facts")
def q_daily_stats_upsert(spark, sf_dir):
    return out(wh(spark, sf_dir, "order").facts, *FACT_OUT)


# --- L1-L3, L7, S9 ----------------------------------------------------------------------------
@register(
    "import_registry",
    S.with_(S.raw_cte())
    + f"SELECT file_key, file_name, '{DEFAULT_SOURCE_TYPE}' AS source_type, CAST(COUNT(*) AS INTEGER) AS rows_count, "
    f"'{LOAD_NOTE}' AS notes FROM raw GROUP BY file_key, file_name",
)
def q_import_registry(spark, sf_dir):
    return state(spark, sf_dir).registry.drop("loaded_at", "file_order")


@register(
    "skip_loaded",
    S.with_(
        S.raw_cte(),
        "cand AS (SELECT DISTINCT file_key, file_name FROM raw)",
        f"reg AS (SELECT file_key, file_name FROM cand WHERE file_key < {PREVIOUS_LOAD_BEFORE})",
    )
    + "SELECT c.file_name, c.file_key, CASE WHEN r.file_key IS NULL THEN 'load' ELSE 'skip' END AS action, "
    "r.file_key AS existing_file_key FROM cand c LEFT JOIN reg r ON r.file_name = c.file_name",
)
def q_skip_loaded(spark, sf_dir):
    st = state(spark, sf_dir)
    previous = st.registry.where(F.col("file_key") < PREVIOUS_LOAD_BEFORE)
    return L.load_plan(L.files_of(st.raw), previous)


@register(
    "replace_detach",
    S.base(file_by="order")
    + f"SELECT ticker, trade_date, CASE WHEN file_key BETWEEN {REPLACED_FROM} AND {REPLACED_TO} THEN NULL "
    "ELSE file_key END AS file_key FROM facts",
)
def q_replace_detach(spark, sf_dir):
    st = state(spark, sf_dir, "order")
    names = st.registry.where(F.col("file_key").between(REPLACED_FROM, REPLACED_TO)).select("file_name")
    return L.replace_files(st, names).facts.select("ticker", "trade_date", "file_key")


@register(
    "archive_manifest",
    S.with_(
        S.raw_cte(),
        "kept AS (SELECT * FROM raw WHERE file_key % 100 <> 2)",
        "bounds AS (SELECT date_trunc('month', min(l_shipdate)::DATE) AS a, date_trunc('month', max(l_shipdate)::DATE) AS b FROM lineitem)",
        "months AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM bounds)",
    )
    + "SELECT printf('MarketStockResult_%04d_%02d.xlsx', year(m), month(m)) AS archive_file, strftime(m, '%Y-%m') AS period_month, "
    "count(r.file_key) AS rows_count, count(DISTINCT r.trade_datetime_raw::DATE) AS trade_days_in_file "
    "FROM months LEFT JOIN kept r ON r.file_key = year(m) * 100 + month(m) GROUP BY m",
)
def q_archive_manifest(spark, sf_dir):
    """Every month has an archive; those of February hold no rows."""
    raw = wh(spark, sf_dir).raw.where(F.col("file_key") % 100 != 2)
    return L.archive_manifest(raw, testdata.archive_months(spark, sf_dir))


@register(
    "raw_row_num",
    S.with_(S.raw_cte())
    + f"SELECT file_key, CAST(ROW_NUMBER() OVER (PARTITION BY file_key ORDER BY {SRC_ORDER_SQL}) AS INTEGER) AS row_num, "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey FROM raw",
)
def q_raw_row_num(spark, sf_dir):
    raw = testdata.raw_trades(spark, sf_dir, with_source_order=True)
    numbered = with_row_number(raw, ["file_key"], testdata.SOURCE_ORDER)
    return numbered.select("file_key", "row_num", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- D1-D10, gate -----------------------------------------------------------------------------
STATE_SQL = [
    S.raw_cte(),
    S.facts_file_cte(),
    S.facts_cte(),
    S.instruments_cte(),
    S.calendar_cte(),
    "issuers AS (SELECT DISTINCT NULLIF(trim(issuer_name_raw), '') AS issuer_name FROM raw "
    "WHERE NULLIF(trim(issuer_name_raw), '') IS NOT NULL)",
    "reg AS (SELECT DISTINCT file_key, file_name, 'x' AS source_type FROM raw)",
]


@register(
    "dq_row_counts",
    S.with_(*STATE_SQL)
    + "SELECT 'import_files' AS object_name, COUNT(*) AS row_count FROM reg UNION ALL "
    "SELECT 'raw_market_archive', COUNT(*) FROM raw UNION ALL SELECT 'issuers', COUNT(*) FROM issuers UNION ALL "
    "SELECT 'instruments', COUNT(*) FROM instruments UNION ALL SELECT 'trading_calendar', COUNT(*) FROM trading_calendar "
    "UNION ALL SELECT 'market_daily_stats', COUNT(*) FROM facts",
)
def q_dq_row_counts(spark, sf_dir):
    return D.row_counts(state(spark, sf_dir))


# Dirty-state scenario: what the checks must find.  Every rule has rows that break it.
def _dirty_state(spark, sf_dir) -> L.ArchiveState:
    st = state(spark, sf_dir)
    year, month, day = F.year("trade_date"), F.month("trade_date"), F.dayofmonth("trade_date")
    odd = lambda c, d: F.when(day == d, -F.abs(F.col(c)) - 1).otherwise(F.col(c)).alias(c)
    spoiled = {"price_min": 1, "price_avg_weighted": 2, "price_aux": 3, "turnover_value": 4, "turnover_qty": 5, "deals_count": 6, "term_days": 7}
    facts = st.facts.select(*[odd(c, spoiled[c]) if c in spoiled else F.col(c) for c in st.facts.columns])
    facts = facts.unionByName(facts.where((year == 1996) & (month == 3)))  # repeated pairs
    blank = lambda c, cond: F.when(cond, F.lit("  ")).otherwise(F.col(c))
    registry = st.registry.where(F.col("file_key") % 100 != 11)  # archives of November have no parent
    registry = registry.withColumn("file_name", blank("file_name", F.col("file_key") % 100 == 5))
    registry = registry.withColumn("source_type", blank("source_type", F.col("file_key") % 100 == 6))
    issuers = st.issuers.where(F.col("issuer_name") != "CHINA")
    issuers = issuers.unionByName(issuers.where(F.col("issuer_name") == "FRANCE"))
    issuers = issuers.withColumn("issuer_name", blank("issuer_name", F.col("issuer_name") == "BRAZIL"))
    last = F.substring("ticker", -1, 1)
    instruments = st.instruments.where(last != "7")
    instruments = instruments.unionByName(instruments.where(last == "3"))
    instruments = instruments.withColumns({"ticker": blank("ticker", last == "5"), "currency_code": blank("currency_code", last == "6")})
    calendar = st.calendar.where(F.month("trade_date") != 12)
    return L.ArchiveState(registry, st.raw, issuers, instruments, calendar, facts)


def _spoiled_sql(column: str, day: int) -> str:
    return f"CASE WHEN day(trade_date) = {day} THEN -abs({column}) - 1 ELSE {column} END AS {column}"


DIRTY_STATE_SQL = [
    "facts_s AS (SELECT * REPLACE ("
    + ", ".join(
        _spoiled_sql(c, d)
        for d, c in enumerate(
            ["price_min", "price_avg_weighted", "price_aux", "turnover_value", "turnover_qty", "deals_count", "term_days"], start=1
        )
    )
    + ") FROM facts)",
    "facts_d AS (SELECT * FROM facts_s UNION ALL SELECT * FROM facts_s WHERE year(trade_date) = 1996 AND month(trade_date) = 3)",
    "reg_d AS (SELECT file_key, CASE WHEN file_key % 100 = 5 THEN '  ' ELSE file_name END AS file_name, "
    "CASE WHEN file_key % 100 = 6 THEN '  ' ELSE source_type END AS source_type FROM reg WHERE file_key % 100 <> 11)",
    "issuers_d AS (SELECT issuer_name AS id, CASE WHEN issuer_name = 'BRAZIL' THEN '  ' ELSE issuer_name END AS issuer_name FROM "
    "(SELECT * FROM issuers UNION ALL SELECT * FROM issuers WHERE issuer_name = 'FRANCE') WHERE issuer_name <> 'CHINA')",
    "instruments_d AS (SELECT ticker AS id, issuer_name, CASE WHEN right(ticker, 1) = '5' THEN '  ' ELSE ticker END AS ticker, "
    "CASE WHEN right(ticker, 1) = '6' THEN '  ' ELSE currency_code END AS currency_code FROM "
    "(SELECT * FROM instruments UNION ALL SELECT * FROM instruments WHERE right(ticker, 1) = '3') WHERE right(ticker, 1) <> '7')",
    "calendar_d AS (SELECT * FROM trading_calendar WHERE month(trade_date) <> 12)",
]


def _cnt(name: str, table: str, cond: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT) AS issue_count FROM {table}"


@register(
    "dq_values",
    S.with_(*STATE_SQL, *DIRTY_STATE_SQL)
    + " UNION ALL ".join(
        [
            _cnt("blank_file_name", "reg_d", "trim(file_name) = ''"),
            _cnt("blank_source_type", "reg_d", "trim(source_type) = ''"),
            _cnt("blank_issuer_name", "issuers_d", "trim(issuer_name) = ''"),
            _cnt("blank_ticker", "instruments_d", "trim(ticker) = ''"),
            _cnt("blank_currency_code", "instruments_d", "trim(currency_code) = ''"),
        ]
        + [
            _cnt(f"negative_{c}", "facts_d", f"{c} < 0")
            for c in ("price_min", "price_avg_weighted", "price_aux", "turnover_value", "turnover_qty", "deals_count", "term_days")
        ]
    ),
)
def q_dq_values(spark, sf_dir):
    return D.value_checks(_dirty_state(spark, sf_dir))


def _dup(name: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, CAST(COUNT(*) AS BIGINT) AS issue_count FROM "
        f"(SELECT {keys} FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1)"
    )


@register(
    "dq_duplicates",
    S.with_(
        *STATE_SQL,
        *DIRTY_STATE_SQL,
        "raw_n AS (SELECT file_key, l_orderkey % 1000 AS row_num FROM raw)",
    )
    + " UNION ALL ".join(
        [
            _dup("duplicate_tickers", "instruments_d", "ticker"),
            _dup("duplicate_issuer_names", "issuers_d", "issuer_name"),
            _dup("duplicate_market_daily_stats_pairs", "facts_d", "ticker, trade_date"),
            _dup("duplicate_raw_file_row_pairs", "raw_n", "file_key, row_num"),
        ]
    ),
)
def q_dq_duplicates(spark, sf_dir):
    st = _dirty_state(spark, sf_dir)
    raw = testdata.raw_trades(spark, sf_dir, with_source_order=True)
    st.raw = raw.withColumn("row_num", (F.col("l_orderkey") % 1000).cast("int"))  # a numbering that repeats
    return D.duplicate_checks(st)


def _orph(name: str, child: str, parent: str, ck: str, pk: str, extra: str = "") -> str:
    return (
        f"SELECT '{name}' AS check_name, COUNT(*) AS issue_count FROM {child} c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck}){extra}"
    )


@register(
    "dq_orphans",
    S.with_(*STATE_SQL, *DIRTY_STATE_SQL)
    + " UNION ALL ".join(
        [
            _orph("raw_without_import_file", "raw", "reg_d", "file_key", "file_key"),
            _orph("instrument_without_issuer", "instruments_d", "issuers_d", "issuer_name", "id"),
            _orph("stats_without_instrument", "facts_d", "instruments_d", "ticker", "id"),
            _orph("stats_without_calendar_date", "facts_d", "calendar_d", "trade_date", "trade_date"),
            _orph("stats_with_invalid_file_id", "facts_d", "reg_d", "file_key", "file_key", " AND c.file_key IS NOT NULL"),
        ]
    ),
)
def q_dq_orphans(spark, sf_dir):
    return D.orphan_checks(_dirty_state(spark, sf_dir))


@register(
    "dq_coverage",
    S.with_(*STATE_SQL)
    + "SELECT MIN(trade_date) AS min_trade_date, MAX(trade_date) AS max_trade_date, COUNT(*) AS total_rows FROM facts",
)
def q_dq_coverage(spark, sf_dir):
    return D.coverage(wh(spark, sf_dir, keep=False).facts)


@register(
    "dq_ticker_coverage",
    S.with_(*STATE_SQL)
    + "SELECT i.ticker, i.issuer_name, COUNT(*) AS stats_rows, MIN(f.trade_date) AS first_trade_date, "
    "MAX(f.trade_date) AS last_trade_date FROM facts f JOIN instruments i ON i.ticker = f.ticker "
    "GROUP BY i.ticker, i.issuer_name",
)
def q_dq_ticker_coverage(spark, sf_dir):
    w = wh(spark, sf_dir, keep=False)
    return D.ticker_coverage(w.facts, w.instruments, w.issuers)


@register(
    "dq_calendar",
    S.with_(*STATE_SQL)
    + "SELECT COUNT(*) AS trading_days_count, MIN(trade_date) AS min_calendar_date, MAX(trade_date) AS max_calendar_date "
    "FROM trading_calendar WHERE is_trading_day",
)
def q_dq_calendar(spark, sf_dir):
    return D.calendar_check(wh(spark, sf_dir).calendar)


@register(
    "dq_derived_counts",
    S.base(S.summary_cte(), S.anomalies_cte())
    + "SELECT 'vw_instrument_daily_metrics' AS object_name, COUNT(*) AS row_count FROM metrics UNION ALL "
    "SELECT 'mv_instrument_summary', COUNT(*) FROM summary UNION ALL SELECT 'vw_market_anomalies', COUNT(*) FROM anomalies "
    "UNION ALL SELECT 'market_daily_stats', COUNT(*) FROM facts UNION ALL "
    "SELECT 'instruments_with_stats', COUNT(DISTINCT ticker) FROM facts",
)
def q_dq_derived_counts(spark, sf_dir):
    w = wh(spark, sf_dir, keep=False)
    return D.derived_counts(w.facts, w.metrics, w.summary, w.anomalies)


@register(
    "dq_last_active",
    S.base(S.summary_cte())
    + "SELECT ticker, stale AS last_active_trade_date, last_active_trade_date AS actual_last_active_trade_date FROM "
    "(SELECT ticker, last_active_trade_date, CASE WHEN right(ticker, 1) IN ('1', '4') THEN last_active_trade_date - 30 "
    "ELSE last_active_trade_date END AS stale FROM summary) WHERE stale IS DISTINCT FROM last_active_trade_date",
)
def q_dq_last_active(spark, sf_dir):
    """Scenario: a stored summary that was not refreshed for some instruments."""
    w = wh(spark, sf_dir)
    day = F.col("last_active_trade_date")
    stale = w.summary.withColumn(
        "last_active_trade_date", F.when(F.substring("ticker", -1, 1).isin("1", "4"), F.date_sub(day, 30)).otherwise(day)
    )
    return D.last_active_recheck(w.metrics, stale).select(
        "ticker", "last_active_trade_date", "actual_last_active_trade_date"
    )


@register(
    "dq_anomaly_domain",
    S.base(S.anomalies_cte())
    + f"SELECT {ANOMALY_SQL} FROM (SELECT * REPLACE (CASE WHEN day(trade_date) = 13 THEN 'unknown' ELSE anomaly_type END "
    "AS anomaly_type) FROM anomalies) WHERE anomaly_type = 'unknown'",
)
def q_dq_anomaly_domain(spark, sf_dir):
    """Scenario: stored anomalies, some with a type from outside."""
    kind = F.when(F.dayofmonth("trade_date") == 13, F.lit("unknown")).otherwise(F.col("anomaly_type"))
    return out(D.anomaly_domain(wh(spark, sf_dir).anomalies.withColumn("anomaly_type", kind)), *ANOMALY_OUT)


@register(
    "dq_reconcile",
    S.base(
        "reg AS (SELECT DISTINCT file_key, file_name FROM raw)",
        "rs AS (SELECT file_key, SUM(turnover_value_raw) AS s FROM raw GROUP BY file_key)",
        "fs AS (SELECT file_key, SUM(turnover_value) AS s FROM facts GROUP BY file_key)",
        file_by="order",
    )
    + "SELECT g.file_key, g.file_name, CAST(COALESCE(r.s, 0) AS DOUBLE) AS raw_turnover_sum, "
    "CAST(COALESCE(f.s, 0) AS DOUBLE) AS stats_turnover_sum, "
    "CAST(ROUND(COALESCE(r.s, 0) - COALESCE(f.s, 0), 2) AS DOUBLE) AS difference "
    "FROM reg g LEFT JOIN rs r ON r.file_key = g.file_key LEFT JOIN fs f ON f.file_key = g.file_key",
)
def q_dq_reconcile(spark, sf_dir):
    st = state(spark, sf_dir, "order")
    return out(D.reconcile(st.registry, st.raw, st.facts))


@register(
    "dq_distinct_pairs",
    S.base()
    + "SELECT COUNT(*) AS market_daily_stats_rows, COUNT(DISTINCT (ticker, trade_date)) AS distinct_instrument_date_pairs "
    "FROM facts",
)
def q_dq_distinct_pairs(spark, sf_dir):
    return D.distinct_pairs(wh(spark, sf_dir, keep=False).facts)


# Gate scenario: archives whose rows break every rule of the schema, some only before aggregation.
GATE_EDITS = {  # column: (quantity of the rows changed, new value)
    "price_min_raw": (50, "-1"), "price_avg_raw": (49, "-100000"), "price_aux_raw": (48, "-100000"),
    "turnover_value_raw": (47, "-100000000000"), "deals_count_raw": (46, "-100"), "term_days_raw": (44, "-1"),
}
SEGMENT_QTY, CURRENCY_QTY, HUGE_QTY, ERROR_QTY, NEGATIVE_QTY = 43, 42, 41, 40, 45


def _gate_raw(spark, sf_dir):
    raw = testdata.raw_trades(spark, sf_dir)
    qty = F.col("turnover_qty_raw").cast("int")
    types = dict(raw.dtypes)
    edit = lambda c, n, v: F.when(qty == n, F.lit(v).cast(types[c])).otherwise(F.col(c))
    edits = {c: edit(c, n, v) for c, (n, v) in GATE_EDITS.items()}
    edits["market_segment_raw"] = edit("market_segment_raw", SEGMENT_QTY, "bonds")
    edits["currency_code_raw"] = edit("currency_code_raw", CURRENCY_QTY, "A LONG CURRENCY")
    edits["deals_count_raw"] = F.when(qty == HUGE_QTY, F.lit(2_147_483_000)).otherwise(edits["deals_count_raw"])
    edits["turnover_qty_raw"] = edit("turnover_qty_raw", NEGATIVE_QTY, "-1000")
    return raw.withColumns(edits | {"load_error": F.when(qty == ERROR_QTY, F.lit("number out of range"))})


def _gate_sql() -> str:
    edited = [f"CASE WHEN l_quantity = {n} THEN {v} ELSE {c} END AS {c}" for c, (n, v) in GATE_EDITS.items() if c != "deals_count_raw"]
    n, v = GATE_EDITS["deals_count_raw"]
    edited += [
        f"CASE WHEN l_quantity = {HUGE_QTY} THEN 2147483000 WHEN l_quantity = {n} THEN {v} ELSE deals_count_raw END::BIGINT AS deals_count_raw",
        f"CASE WHEN l_quantity = {SEGMENT_QTY} THEN 'bonds' ELSE market_segment_raw END AS market_segment_raw",
        f"CASE WHEN l_quantity = {CURRENCY_QTY} THEN 'A LONG CURRENCY' ELSE currency_code_raw END AS currency_code_raw",
        f"CASE WHEN l_quantity = {NEGATIVE_QTY} THEN -1000 ELSE turnover_qty_raw END AS turnover_qty_raw",
    ]
    facts = S.facts_file_cte("g", "gf").replace("GROUP BY file_key,", "GROUP BY file_key, market_segment_raw,")
    facts = facts.replace("CAST(SUM(COALESCE(deals_count_raw, 0)) AS INTEGER)", "SUM(COALESCE(deals_count_raw, 0))")
    count = lambda rule, source, cond: (
        f"SELECT file_key, '{rule}' AS rule, count(*) AS violations FROM {source} WHERE {cond} GROUP BY file_key"
    )
    signed = ["price_min", "price_avg_weighted", "price_aux", "turnover_value", "turnover_qty", "term_days"]
    rules = [
        count("load_error", "g", f"l_quantity = {ERROR_QTY}"),
        count("calendar_year_out_of_range", "(SELECT DISTINCT file_key, trade_datetime_raw::DATE AS d FROM g)", "year(d) < 2000"),
        count("currency_code_too_long", "gi_t", "length(currency_code) > 10"),
        count("negative_instrument_term_days", "gi_t", "term_days < 0"),
        count("instrument_conflict", "(SELECT file_key, ticker, count(*) AS n FROM gi_t GROUP BY ALL)", "n > 1"),
        count("mixed_market_segment", "(SELECT file_key, ticker, trade_date, count(*) AS n FROM gf GROUP BY ALL)", "n > 1"),
        count("value_out_of_range", "gf", "deals_count > 2147483647"),
        count("negative_deals_count", "gf", "deals_count < 0"),
        *[count(f"negative_{c}", "gf", f"{c} < 0") for c in signed],
    ]
    head = S.with_(S.raw_cte(), f"g AS (SELECT * REPLACE ({', '.join(edited)}) FROM raw)", facts, S.instruments_cte("g", "gi"))
    return head + " UNION ALL ".join(rules)


@register("dq_gate", _gate_sql())
def q_dq_gate(spark, sf_dir):
    return D.gate_violations(_gate_raw(spark, sf_dir))


# --- L4: a batch load on top of an earlier one --------------------------------------------------
# Scenario: the archives before 1996 are loaded; a second run brings all archives, of which the one of
# September 1996 quotes some tickers in two currencies.  It is rejected, later ones are not loaded.
REJECTED = 199609


def _second_load(spark, sf_dir, replace: bool):
    w = wh(spark, sf_dir)
    key = F.col("file_key")
    files = L.files_of(w.raw).withColumn("file_order", key)
    before = lambda df: df.where(key < 199601)
    options = {"loaded_at": LOADED_AT, "gate_options": {"min_year": 1900}}
    first, _ = L.load_batch(None, before(w.raw), before(files), **options)
    euro = (key == REJECTED) & (F.col("deals_count_raw") == 1)
    raw = w.raw.withColumn("currency_code_raw", F.when(euro, F.lit("EUR")).otherwise(F.col("currency_code_raw")))
    return L.load_batch(first, raw, files, replace=replace, **options)


_FILES_SQL = "f AS (SELECT DISTINCT file_key, file_name FROM raw)"


def _status_sql(done: str) -> str:
    return (
        f"CASE WHEN file_key < 199601 THEN '{done}' WHEN file_key < {REJECTED} THEN 'loaded' "
        f"WHEN file_key = {REJECTED} THEN 'rejected' ELSE 'aborted' END"
    )


@register("load_batch_report", S.with_(S.raw_cte(), _FILES_SQL) + f"SELECT file_name, file_key, {_status_sql('skipped')} AS status FROM f")
def q_load_batch_report(spark, sf_dir):
    return _second_load(spark, sf_dir, replace=False)[1].select("file_name", "file_key", "status")


@register(
    "replace_rejected",
    S.with_(S.raw_cte())
    + f"SELECT file_name, file_key, CAST(count(*) AS INTEGER) AS rows_count FROM raw WHERE file_key < {REJECTED} GROUP BY ALL",
)
def q_replace_rejected(spark, sf_dir):
    return _second_load(spark, sf_dir, replace=True)[0].registry.select("file_name", "file_key", "rows_count")


# --- L4, M11, L6: published state and stored summary --------------------------------------------
def _published(spark, sf_dir, **options) -> str:
    """All archives in three loads, published one after the other."""
    root = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    w, key = wh(spark, sf_dir, keep=False), F.col("file_key")
    files = L.files_of(w.raw).withColumn("file_order", key).checkpoint()  # a row for each file, listed once
    for low, high in ((None, 199601), (199601, REJECTED), (REJECTED, None)):
        part = (F.lit(True) if low is None else key >= low) & (F.lit(True) if high is None else key < high)
        state_now, _ = L.load_batch(
            L.read_state(spark, root), w.raw.where(part), files.where(part), loaded_at=LOADED_AT, gate_options={"min_year": 1900}
        )
        L.publish(state_now, root, **options)
    return root


@register("published_facts", S.base() + f"SELECT {FACT_SQL} FROM facts")
def q_published_facts(spark, sf_dir):
    return out(L.read_state(spark, _published(spark, sf_dir)).facts, *FACT_OUT)


def _stored_summary(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    M.save_summary(wh(spark, sf_dir).summary.where(F.substring("ticker", -1, 1) != "3"), path)
    return path


@register("materialized_summary", S.base(S.summary_cte()) + f"SELECT {SUMMARY_SQL} FROM summary WHERE right(ticker, 1) <> '3'")
def q_materialized_summary(spark, sf_dir):
    """A saved summary is read as it was saved (here: without some instruments) until refreshed."""
    return summary_out(spark.read.parquet(_stored_summary(spark, sf_dir)))


@register("refreshed_summary", S.base(S.summary_cte()) + f"SELECT {SUMMARY_SQL} FROM summary")
def q_refreshed_summary(spark, sf_dir):
    """The summary stored with the first of three loads and refreshed by the others."""
    return summary_out(L.read_summary(spark, _published(spark, sf_dir, summary=True)))
