"""Normalisation of the raw archive layer: issuers, instruments, calendar, daily facts.

The reference loads archive files one by one (insert-ignore dimensions, upsert facts).  Here
all files are folded in one distributed pass: aggregate per (file, ticker, day), then keep the
latest file per key.  Because every file's instrument upsert precedes its fact insert and a
file with two different tuples for one ticker is rejected, the fold equals the sequential loop.

Surrogate ids are ``xxhash64`` of the natural key: stable across loads and computable on any
executor without a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import btrim_blank_null
from ..schemas import (
    DEFAULT_CURRENCY,
    DEFAULT_INSTRUMENT_TYPE,
    DEFAULT_MARKET_SEGMENT,
    FACT_VALUE_COLUMNS,
)
from ..session import tasks_for


def issuer_id(name: str | Column) -> Column:
    return F.xxhash64(F.col(name) if isinstance(name, str) else name)


def instrument_id(ticker: str | Column) -> Column:
    return F.xxhash64(F.col(ticker) if isinstance(ticker, str) else ticker)


def _file_order(raw: DataFrame) -> Column:
    # Files are processed in sorted name order; file_order is supplied by the scan, the test
    # mapping's yyyymm key sorts like its file names.
    return F.col("file_order") if "file_order" in raw.columns else F.col("file_key")


# --- one pass over raw ----------------------------------------------------------------------
PART_KEYS = [
    "file_order",
    "file_key",
    "ticker",
    "issuer_name",
    "currency_code",
    "term_days",
    "trade_date",
    "market_segment",
]


def cleaned_rows(raw: DataFrame, default_segment: str = DEFAULT_MARKET_SEGMENT) -> DataFrame:
    """Raw rows with the keys of `daily_parts`, one row for each raw row, ``n_rows`` and ``error_rows``
    counting one each.  What needs keys alone (dimensions, registry, the gate's row rules) derives from
    these as from parts, without shuffling a row."""
    error = F.col("load_error") if "load_error" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        _file_order(raw).alias("file_order"),
        "file_key",
        btrim_blank_null("ticker_raw").alias("ticker"),
        btrim_blank_null("issuer_name_raw").alias("issuer_name"),
        F.coalesce(btrim_blank_null("currency_code_raw"), F.lit(DEFAULT_CURRENCY)).alias("currency_code"),
        F.col("term_days_raw").alias("term_days"),
        F.to_date("trade_datetime_raw").alias("trade_date"),
        F.coalesce(btrim_blank_null("market_segment_raw"), F.lit(default_segment)).alias("market_segment"),
        *[c for c in raw.columns if c.endswith("_raw")],
        F.lit(1).cast("long").alias("n_rows"),
        error.isNotNull().cast("long").alias("error_rows"),
    )


def daily_parts(raw: DataFrame, default_segment: str = DEFAULT_MARKET_SEGMENT, tasks: int | None = None) -> DataFrame:
    """The only pass over the raw layer: rows grouped by file, cleaned ticker / issuer /
    currency, term, trade date and segment (any of them may be NULL), with numeric partial
    aggregates.  Dimensions, facts, registry counts and gate rules all derive from this compact
    table (about one row per fact), so the raw layer is scanned once per load.

    There is about one group for each raw row, so a map-side step would not shrink the rows, only widen
    them and hold them all: the rows are dealt out by ticker and day first, and each small partition is
    grouped on its own (every buffer is numeric, so by hash).  A hot ticker is spread over its days, a hot
    file over its tickers and days; facts are folded on the same partitions (``tasks``, as many as the
    size of the input asks for)."""
    tasks = tasks or tasks_for(raw)
    v, q, y = F.col("price_avg_raw"), F.col("turnover_qty_raw"), F.col("yield_avg_raw")
    pos_q = F.coalesce(q, F.lit(0)) > 0
    zero = F.lit(0)
    return cleaned_rows(raw, default_segment).repartition(tasks, "ticker", "trade_date").groupBy(*PART_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("price_min_raw").alias("price_min"),
        F.sum(F.when(v.isNotNull() & pos_q, q).otherwise(zero)).alias("p_weight"),
        F.sum(v * q).alias("p_num"),
        F.sum(v).alias("p_sum"),
        F.count(v).alias("p_cnt"),
        F.sum("price_aux_raw").alias("aux_sum"),
        F.count("price_aux_raw").alias("aux_cnt"),
        F.min("yield_min_raw").alias("yield_min"),
        F.max("yield_max_raw").alias("yield_max"),
        F.sum(F.when(y.isNotNull() & pos_q, q).otherwise(zero)).alias("y_weight"),
        F.sum(y * q).alias("y_num"),
        F.sum(y).alias("y_sum"),
        F.count(y).alias("y_cnt"),
        F.sum(F.coalesce("turnover_value_raw", zero)).alias("tv_sum"),
        F.sum(F.coalesce("turnover_qty_raw", zero)).alias("tq_sum"),
        F.sum(F.coalesce("deals_count_raw", zero).cast("long")).alias("deals_sum"),
        F.sum("turnover_value_raw").alias("tv_raw_sum"),
        F.sum("error_rows").alias("error_rows"),
    )


def _reaching(parts: DataFrame) -> DataFrame:
    """Parts whose rows reach the dimensions (non-blank ticker and issuer)."""
    return parts.where(F.col("ticker").isNotNull() & F.col("issuer_name").isNotNull())


# --- N1 ---------------------------------------------------------------------------------------
def issuers_from_parts(parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    names = parts.where(F.col("issuer_name").isNotNull()).select("issuer_name").distinct()
    if existing is not None:
        names = names.join(existing.select("issuer_name"), "issuer_name", "left_anti")
    new = names.select(
        issuer_id("issuer_name").alias("issuer_id"),
        "issuer_name",
        F.lit(None).cast("string").alias("issuer_short_name"),
        F.lit(True).alias("is_active"),
    )
    return new if existing is None else existing.unionByName(new)


def build_issuers(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct trimmed non-blank issuer names; names already present are left untouched."""
    return issuers_from_parts(daily_parts(raw), existing)


# --- N2 ---------------------------------------------------------------------------------------
def instrument_tuples(parts: DataFrame, instrument_type: str = DEFAULT_INSTRUMENT_TYPE) -> DataFrame:
    """Distinct (file, ticker, issuer, currency, type, term_days) of rows that reach the join."""
    return (
        _reaching(parts)
        .select(
            "file_order",
            "file_key",
            "ticker",
            "issuer_name",
            "currency_code",
            F.lit(instrument_type).alias("instrument_type"),
            "term_days",
        )
        .distinct()
    )


def conflicts_from_parts(parts: DataFrame, instrument_type: str = DEFAULT_INSTRUMENT_TYPE) -> DataFrame:
    return (
        instrument_tuples(parts, instrument_type)
        .groupBy("file_key", "ticker")
        .agg(F.count(F.lit(1)).alias("variants"))
        .where(F.col("variants") > 1)
    )


def instrument_conflicts(raw: DataFrame, instrument_type: str = DEFAULT_INSTRUMENT_TYPE) -> DataFrame:
    """Tickers with more than one (issuer, currency, term) tuple inside one file.

    Such a file cannot be loaded (the reference's upsert refuses to touch a row twice); the
    quality gate rejects the whole file.
    """
    return conflicts_from_parts(daily_parts(raw), instrument_type)


RANKS = ["file_rank", "term_rank"]


def _ranked(df: DataFrame, columns: list[str] = RANKS) -> DataFrame:
    """``df`` with its rank columns; a table stored without them has null ranks, below any file."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def upsert_instruments(
    parts: DataFrame, ranks: DataFrame, existing: DataFrame | None = None, instrument_type: str = DEFAULT_INSTRUMENT_TYPE
) -> DataFrame:
    """Instruments whose descriptors carry the rank of the file they come from (``ranks``: file_key,
    file_rank): the greater rank wins, whether it is stored or new, and the greatest rank with a term
    sets ``term_days``.  The result does not depend on the order in which files arrive."""
    values = ["issuer_id", "currency_code", "instrument_type", "is_active"]
    rows = instrument_tuples(parts, instrument_type).join(F.broadcast(ranks), "file_key").select(
        "ticker", issuer_id("issuer_name").alias("issuer_id"), "currency_code", "instrument_type",
        F.lit(True).alias("is_active"), "term_days", "file_rank", F.when(F.col("term_days").isNotNull(), F.col("file_rank")).alias("term_rank"),
    )
    if existing is not None:
        rows = rows.unionByName(_ranked(existing).select("ticker", *values, "term_days", *RANKS))
    term = F.when(F.col("term_days").isNotNull(), F.struct(F.coalesce("term_rank", F.lit("")).alias("r"), "term_days", "term_rank"))
    best = rows.groupBy("ticker").agg(
        F.max_by(F.struct(*values, "file_rank"), F.coalesce("file_rank", F.lit(""))).alias("t"), F.max(term).alias("d")
    )
    return best.select(
        instrument_id("ticker").alias("instrument_id"), "ticker", "t.issuer_id", "t.currency_code", "t.instrument_type",
        "d.term_days", "t.is_active", "t.file_rank", "d.term_rank",
    )


def instruments_from_parts(
    parts: DataFrame,
    existing: DataFrame | None = None,
    instrument_type: str = DEFAULT_INSTRUMENT_TYPE,
) -> DataFrame:
    # Of each tuple its last file, by hash: a few rows for each ticker, however many files quote it.
    last = _reaching(parts).groupBy("ticker", "issuer_name", "currency_code", "term_days").agg(F.max("file_order").alias("file_order"))
    tuples = last.select(
        "file_order",
        "ticker",
        issuer_id("issuer_name").alias("issuer_id"),
        "currency_code",
        F.lit(instrument_type).alias("instrument_type"),
        "term_days",
        F.lit(True).alias("is_active"),
    )
    if existing is not None:
        # Existing rows rank below every file of this load.
        tuples = tuples.unionByName(
            existing.select(
                F.lit(None).cast("long").alias("file_order"),
                "ticker",
                "issuer_id",
                "currency_code",
                "instrument_type",
                "term_days",
                "is_active",
            )
        )
    order = F.coalesce(F.col("file_order"), F.lit(-(2**62)))
    latest = F.max_by(F.struct("issuer_id", "currency_code", "instrument_type", "is_active"), order)
    term = F.max_by(F.col("term_days"), F.when(F.col("term_days").isNotNull(), order))
    return (
        tuples.groupBy("ticker")
        .agg(latest.alias("t"), term.alias("term_days"))
        .select(
            instrument_id("ticker").alias("instrument_id"),
            "ticker",
            "t.issuer_id",
            "t.currency_code",
            "t.instrument_type",
            "term_days",
            "t.is_active",
        )
    )


def build_instruments(
    raw: DataFrame,
    existing: DataFrame | None = None,
    instrument_type: str = DEFAULT_INSTRUMENT_TYPE,
) -> DataFrame:
    """Upsert by ticker: the latest file sets issuer, currency and type; term_days keeps the
    latest non-NULL value (``COALESCE(new, old)``); other columns of existing rows are kept."""
    return instruments_from_parts(daily_parts(raw), existing, instrument_type)


# --- N3 ---------------------------------------------------------------------------------------
def calendar_rows(dates: DataFrame) -> DataFrame:
    d = F.col("trade_date")
    return dates.select(
        d,
        F.year(d).alias("year_num"),
        F.month(d).alias("month_num"),
        F.quarter(d).alias("quarter_num"),
        F.weekofyear(d).alias("week_num"),  # ISO week, like EXTRACT(WEEK)
        F.lit(True).alias("is_trading_day"),
    )


def calendar_from_parts(parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    dates = parts.where(F.col("trade_date").isNotNull()).select("trade_date").distinct()
    if existing is not None:
        dates = dates.join(existing.select("trade_date"), "trade_date", "left_anti")
    new = calendar_rows(dates)
    return new if existing is None else existing.unionByName(new)


def build_calendar(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every distinct date with a trade time, even on rows whose ticker or issuer is blank."""
    return calendar_from_parts(daily_parts(raw), existing)


# --- N4 ---------------------------------------------------------------------------------------
def _weighted(num: str, weight: str, total: str, count: str, precision: int, scale: int) -> Column:
    """Quantity-weighted mean; plain mean where no positive quantity; exact, half-up rounded.

    The numerator is unconditional (a negative quantity subtracts there but not in the weight).
    """
    dec = f"decimal({precision},{scale})"
    weighted = F.try_divide(F.col(num), F.col(weight)).try_cast(dec)
    plain = F.try_divide(F.col(total), F.col(count)).try_cast(dec)
    return F.when(F.col(weight) > 0, weighted).otherwise(plain)


_PART_SUMS = {
    "p_weight": F.sum,
    "p_num": F.sum,
    "p_sum": F.sum,
    "p_cnt": F.sum,
    "aux_sum": F.sum,
    "aux_cnt": F.sum,
    "y_weight": F.sum,
    "y_num": F.sum,
    "y_sum": F.sum,
    "y_cnt": F.sum,
    "tv_sum": F.sum,
    "tq_sum": F.sum,
    "deals_sum": F.sum,
    "price_min": F.min,
    "yield_min": F.min,
    "yield_max": F.max,
    "term_days": F.max,
}
FACT_KEYS = ["ticker", "trade_date", "file_order", "file_key", "market_segment"]


def _finish_facts(c: DataFrame, *more: str) -> DataFrame:
    """Fact values of summed parts; one that does not fit its column is NULL (the gate rejects its file)."""
    return c.select(
        *more,
        "file_order",
        "file_key",
        "ticker",
        "trade_date",
        F.col("price_min").cast("decimal(18,6)").alias("price_min"),
        _weighted("p_num", "p_weight", "p_sum", "p_cnt", 18, 6).alias("price_avg_weighted"),
        F.try_divide(F.col("aux_sum"), F.col("aux_cnt")).cast("decimal(18,6)").alias("price_aux"),
        F.col("yield_min").cast("decimal(12,6)").alias("yield_min_pct"),
        F.col("yield_max").cast("decimal(12,6)").alias("yield_max_pct"),
        _weighted("y_num", "y_weight", "y_sum", "y_cnt", 12, 6).alias("yield_avg_pct"),
        F.col("tv_sum").try_cast("decimal(20,2)").alias("turnover_value"),
        F.col("tq_sum").try_cast("decimal(20,6)").alias("turnover_qty"),
        F.col("deals_sum").try_cast("int").alias("deals_count"),
        "term_days",
        "market_segment",
    )


def _fact_parts(parts: DataFrame) -> DataFrame:
    return _reaching(parts).where(F.col("trade_date").isNotNull())


def per_file_sums(parts: DataFrame) -> DataFrame:
    """N4 sums per archive file: one row per (file, ticker, trade date); rows need a trade time, a
    non-blank ticker and a non-blank issuer (the issuer join).

    The market segment is a per-file constant stamped by the loader, so it is a grouping key
    rather than a string MAX (which would force a sort-based aggregation); the gate rejects a
    file that mixes segments for one key."""
    return _fact_parts(parts).groupBy(*FACT_KEYS).agg(*[fn(k).alias(k) for k, fn in _PART_SUMS.items()])


def finished_parts(parts: DataFrame) -> DataFrame:
    """Parts with their fact values in place of the sums, so that neither the gate nor the facts sum again.

    Right for files in which a ticker has one (issuer, currency, term): there a part that reaches the facts is
    all of its (file, ticker, day, segment).  The gate rejects every other file, by its tuples."""
    return _finish_facts(parts, "issuer_name", "currency_code", "n_rows", "error_rows", "p_cnt", "y_cnt")


def per_file_facts(parts: DataFrame) -> DataFrame:
    """Fact values per archive file, ticker, day and segment, of parts or of `finished_parts`."""
    if "price_avg_weighted" in parts.columns:
        return _fact_parts(parts)
    return _finish_facts(per_file_sums(parts), "p_cnt", "y_cnt")


DESCRIPTORS = ["issuer_name", "currency_code"]


def described_facts(parts: DataFrame, instrument_type: str = DEFAULT_INSTRUMENT_TYPE, tasks: int | None = None) -> DataFrame:
    """N4 + N5 + the instrument's descriptors.

    The parts lie by ticker and day; there the parts of each day's latest file are picked and folded into
    finished facts, which carry the descriptors of that file.  Only these narrow rows are then dealt out by
    ticker, where the descriptors of the ticker's latest file are picked (a file that brings no day sends
    a row without one) and the instrument windows downstream run; neither dimension is derived again and
    joined."""
    same_day, same_ticker = Window.partitionBy("ticker", "trade_date"), Window.partitionBy("ticker")
    p = _reaching(parts).withColumns({"_latest": F.max("file_order").over(same_day), "_who": F.max(F.struct("file_order", *DESCRIPTORS)).over(same_day)})
    p = p.where(F.col("file_order") == F.col("_latest")).withColumns({c: F.col(f"_who.{c}") for c in DESCRIPTORS})
    c = p.groupBy(*FACT_KEYS, *DESCRIPTORS).agg(*[fn(k).alias(k) for k, fn in _PART_SUMS.items()])
    days = _finish_facts(c, *DESCRIPTORS).repartition(tasks or tasks_for(parts), "ticker")
    days = days.withColumn("_who", F.max(F.struct("file_order", *DESCRIPTORS)).over(same_ticker)).where(F.col("trade_date").isNotNull())
    days = days.withColumns({c: F.col(f"_who.{c}") for c in DESCRIPTORS})
    who = [F.col("issuer_name"), issuer_id("issuer_name").alias("issuer_id"), F.col("currency_code"), F.lit(instrument_type).alias("instrument_type")]
    return _with_ids(days, *who)


def facts_from_parts(parts: DataFrame) -> DataFrame:
    """Facts of the latest file per (ticker, day), without descriptors."""
    latest = F.max("file_order").over(Window.partitionBy("ticker", "trade_date"))
    p = _fact_parts(parts).withColumn("_latest", latest)
    p = p.where(F.col("file_order") == F.col("_latest"))
    if "price_avg_weighted" in parts.columns:  # finished already
        return _with_ids(p)
    c = p.groupBy(*FACT_KEYS).agg(*[fn(k).alias(k) for k, fn in _PART_SUMS.items()])
    return _with_ids(_finish_facts(c))


def _with_ids(f: DataFrame, *more: Column) -> DataFrame:
    return f.select(
        F.xxhash64("ticker", "trade_date").alias("stat_id"),
        instrument_id("ticker").alias("instrument_id"),
        "ticker",
        "trade_date",
        *FACT_VALUE_COLUMNS,
        "file_key",
        F.localtimestamp().alias("created_at"),
        *more,
    )


# --- N5 ---------------------------------------------------------------------------------------
def build_daily_stats(raw: DataFrame, default_segment: str = DEFAULT_MARKET_SEGMENT) -> DataFrame:
    """N4 + N5 over all files of a batch."""
    return facts_from_parts(daily_parts(raw, default_segment))


def daily_stats_from_parts(parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Facts of a batch (latest file per key) upserted over ``existing`` facts: new keys replace
    old ones whole (anti join + union, no aggregation over the existing table)."""
    new = facts_from_parts(parts)
    if existing is None:
        return new
    kept = existing.join(new.select("ticker", "trade_date"), ["ticker", "trade_date"], "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def upsert_daily_stats(parts: DataFrame, ranks: DataFrame, existing: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Facts that carry the rank of their file (``ranks``: file_key, file_rank).  Of the stored and the
    new fact of a (ticker, day) the greater rank stays, so the facts do not depend on the order in
    which files arrive; a fact without a rank (detached, or stored without ranks) loses to any file.
    A filter on days reaches the stored facts below the window.  ``tasks``: the partitions by ticker and day
    that ``parts`` lie on; stored facts are dealt to the same, and new ones stay where they are."""
    new = facts_from_parts(parts).join(F.broadcast(ranks), "file_key")  # a row for each file
    if existing is None:
        return new
    old = _ranked(existing, ["file_rank"])
    if tasks:
        old = old.repartition(tasks, "ticker", "trade_date")
    both = old.unionByName(new.select(*old.columns))
    rank = F.coalesce("file_rank", F.lit(""))
    best = F.max(rank).over(Window.partitionBy("ticker", "trade_date"))
    return both.withColumn("_best", best).where(rank == F.col("_best")).drop("_best")
