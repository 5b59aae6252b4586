"""Data-quality checks over the archive state and the publish gate.

Each check is one aggregation per table (rules of a table are counted in the same scan and
unpivoted afterwards), so the suite costs a handful of scans instead of one per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANOMALY_TYPES, DEFAULT_INSTRUMENT_TYPE, INSTRUMENT_TYPES
from ..session import tasks_for
from .loading import ArchiveState


def _counts(df: DataFrame, rules: dict[str, Column], name_col: str = "check_name") -> DataFrame:
    """Count the rows matching each rule in one pass; one output row per rule (0 included)."""
    agg = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(n) for n, cond in rules.items()])
    stack = ", ".join(f"'{n}', coalesce(`{n}`, 0L)" for n in rules)
    return agg.selectExpr(f"stack({len(rules)}, {stack}) AS ({name_col}, issue_count)")


# --- D1 ---------------------------------------------------------------------------------------
def row_counts(state: ArchiveState) -> DataFrame:
    frames = {
        "import_files": state.registry,
        "raw_market_archive": state.raw,
        "issuers": state.issuers,
        "instruments": state.instruments,
        "trading_calendar": state.calendar,
        "market_daily_stats": state.facts,
    }
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("object_name"), "row_count") for n, df in frames.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --- D2 ---------------------------------------------------------------------------------------
def value_checks(state: ArchiveState) -> DataFrame:
    blank = lambda c: F.btrim(F.col(c)) == F.lit("")
    neg = lambda c: F.col(c) < 0
    parts = [
        _counts(state.registry, {"blank_file_name": blank("file_name"), "blank_source_type": blank("source_type")}),
        _counts(state.issuers, {"blank_issuer_name": blank("issuer_name")}),
        _counts(state.instruments, {"blank_ticker": blank("ticker"), "blank_currency_code": blank("currency_code")}),
        _counts(
            state.facts,
            {
                f"negative_{c}": neg(c)
                for c in (
                    "price_min",
                    "price_avg_weighted",
                    "price_aux",
                    "turnover_value",
                    "turnover_qty",
                    "deals_count",
                    "term_days",
                )
            },
        ),
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --- D3 ---------------------------------------------------------------------------------------
def _dup_groups(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("issue_count"))
        .select(F.lit(name).alias("check_name"), F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
    )


SEQUENCE_BLOCK = 1 << 16  # numbers hashed by one row of the proof


def unproven_files(raw: DataFrame) -> DataFrame:
    """file_key of the files whose row numbers are not proven to be 1..n, each once.

    The proof is one mergeable aggregate: count, least, greatest and the exclusive-or of two 64-bit hashes
    of the numbers.  n numbers of which an odd count of times occur exactly those hashed into the
    exclusive-or of 1..n are 1..n each once, but for a chance of 2^-128.  What 1..n must give is computed
    from n alone, in blocks that are dealt out, so raw rows are never shuffled."""
    number = F.col("row_num").cast("long")
    first, second = (lambda x: F.xxhash64(x)), (lambda x: F.xxhash64(F.lit(1), x))
    seen = raw.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("numbered"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.bit_xor(first(number)).alias("a"), F.bit_xor(second(number)).alias("b"),
    )
    likely = seen.where("n = numbered and low = 1 and high = n")
    blocks = likely.select("file_key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SEQUENCE_BLOCK}"))).alias("block"))
    blocks = blocks.repartition("file_key", "block").withColumn(
        "numbers", F.sequence(F.col("block") * SEQUENCE_BLOCK + 1, F.least((F.col("block") + 1) * SEQUENCE_BLOCK, F.col("n")))
    )
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "file_key",
        F.aggregate("numbers", zero, lambda acc, x: acc.bitwiseXOR(first(x))).alias("a"),
        F.aggregate("numbers", zero, lambda acc, x: acc.bitwiseXOR(second(x))).alias("b"),
    )
    want = blocks.groupBy("file_key").agg(F.bit_xor("a").alias("want_a"), F.bit_xor("b").alias("want_b"))
    proven = likely.join(want, "file_key").where("a = want_a and b = want_b")
    return seen.select("file_key").join(proven.select("file_key"), "file_key", "left_anti")


def _to_recheck(raw: DataFrame) -> DataFrame:
    """Rows of the files that `unproven_files` names; without any, nothing is read again."""
    failed = F.broadcast(unproven_files(raw).withColumnRenamed("file_key", "_failed"))  # a row for each file: rows stay where they are
    return raw.join(failed, raw["file_key"].eqNullSafe(failed["_failed"]), "left_semi")


def duplicate_checks(state: ArchiveState) -> DataFrame:
    # Nearly every pair is a group of its own: counted on partitions whose number follows the input's size.
    pairs = state.facts.select("instrument_id", "trade_date")
    parts = [
        _dup_groups(state.instruments, ["ticker"], "duplicate_tickers"),
        _dup_groups(state.issuers, ["issuer_name"], "duplicate_issuer_names"),
        _dup_groups(pairs.repartition(tasks_for(state.facts), *pairs.columns), pairs.columns, "duplicate_market_daily_stats_pairs"),
        _dup_groups(_to_recheck(state.raw), ["file_key", "row_num"], "duplicate_raw_file_row_pairs"),
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --- D4 ---------------------------------------------------------------------------------------
def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str, allow_null: bool = False) -> DataFrame:
    # Rows are counted by key first, so keys are joined, not rows.  An anti join keeps NULL keys (they
    # match nothing), like LEFT JOIN ... IS NULL.
    c = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if allow_null:
        c = c.where(F.col(key).isNotNull())
    n = c.join(parent.select(key).distinct(), key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"))
    return n.select(F.lit(name).alias("check_name"), "issue_count")


def orphan_checks(state: ArchiveState) -> DataFrame:
    parts = [
        _orphans(state.raw, state.registry, "file_key", "raw_without_import_file"),
        _orphans(state.instruments, state.issuers, "issuer_id", "instrument_without_issuer"),
        _orphans(state.facts, state.instruments, "instrument_id", "stats_without_instrument"),
        _orphans(state.facts, state.calendar, "trade_date", "stats_without_calendar_date"),
        _orphans(state.facts, state.registry, "file_key", "stats_with_invalid_file_id", allow_null=True),
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --- D5 ---------------------------------------------------------------------------------------
def coverage(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.min("trade_date").alias("min_trade_date"),
        F.max("trade_date").alias("max_trade_date"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def ticker_coverage(facts: DataFrame, instruments: DataFrame, issuers: DataFrame) -> DataFrame:
    days = F.col("trade_date")
    f = facts.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min(days).alias("first"), F.max(days).alias("last"))
    i = instruments.select("instrument_id", F.col("ticker").alias("i_ticker"), "issuer_id")
    s = issuers.select("issuer_id", "issuer_name")
    return (
        f.join(i, "instrument_id")  # a row for each instrument, not for each fact
        .join(s, "issuer_id")
        .groupBy(F.col("i_ticker").alias("ticker"), "issuer_name")
        .agg(
            F.sum("n").alias("stats_rows"),
            F.min("first").alias("first_trade_date"),
            F.max("last").alias("last_trade_date"),
        )
        .orderBy(F.col("stats_rows").desc(), "ticker")
    )


def calendar_check(calendar: DataFrame) -> DataFrame:
    return calendar.where(F.col("is_trading_day")).agg(
        F.count(F.lit(1)).alias("trading_days_count"),
        F.min("trade_date").alias("min_calendar_date"),
        F.max("trade_date").alias("max_calendar_date"),
    )


# --- D6-D8 ------------------------------------------------------------------------------------
def derived_counts(facts: DataFrame, metrics: DataFrame, summary: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Row counts of the derived objects and the two consistency figures."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("object_name"), "row_count")
    parts = [
        one(metrics, "vw_instrument_daily_metrics"),
        one(summary, "mv_instrument_summary"),
        one(anomalies, "vw_market_anomalies"),
        one(facts, "market_daily_stats"),
        facts.agg(F.countDistinct("instrument_id").alias("row_count")).select(
            F.lit("instruments_with_stats").alias("object_name"), "row_count"
        ),
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def last_active_recheck(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """Summary rows whose last active date differs from a recomputation (expected: none)."""
    actual = (
        metrics.where(F.col("is_active_day"))
        .groupBy("instrument_id")
        .agg(F.max("trade_date").alias("actual_last_active_trade_date"))
    )
    return (
        summary.select("instrument_id", "ticker", "last_active_trade_date")
        .join(actual, "instrument_id")
        .where(~F.col("last_active_trade_date").eqNullSafe(F.col("actual_last_active_trade_date")))
    )


def anomaly_domain(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(~F.col("anomaly_type").isin(list(ANOMALY_TYPES)))


# --- D9-D10 -----------------------------------------------------------------------------------
def reconcile(registry: DataFrame, raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Per registered file: raw turnover, fact turnover attributed to the file, difference.

    A non-zero difference is legitimate where a later file overwrote a day or rows were
    filtered (blank ticker, no time)."""
    r = raw.groupBy("file_key").agg(F.sum("turnover_value_raw").alias("raw_turnover_sum"))
    m = facts.groupBy("file_key").agg(F.sum("turnover_value").alias("stats_turnover_sum"))
    zero = F.lit(0).cast("decimal(38,2)")
    j = registry.select("file_key", "file_name").join(r, "file_key", "left").join(m, "file_key", "left")
    raw_sum = F.coalesce(F.col("raw_turnover_sum").cast("decimal(38,2)"), zero)
    st_sum = F.coalesce(F.col("stats_turnover_sum").cast("decimal(38,2)"), zero)
    return j.select(
        "file_key",
        "file_name",
        raw_sum.alias("raw_turnover_sum"),
        st_sum.alias("stats_turnover_sum"),
        F.round(raw_sum - st_sum, 2).alias("difference"),
    ).orderBy("file_key")


def distinct_pairs(facts: DataFrame) -> DataFrame:
    """Rows vs distinct (instrument, date) pairs; a pair with a NULL field still counts."""
    return facts.agg(
        F.count(F.lit(1)).alias("market_daily_stats_rows"),
        F.countDistinct(F.struct("instrument_id", "trade_date")).alias("distinct_instrument_date_pairs"),
    )


# --- Q-gate -----------------------------------------------------------------------------------
FACT_RULES = {
    "negative_price_min": "price_min",
    "negative_price_avg_weighted": "price_avg_weighted",
    "negative_price_aux": "price_aux",
    "negative_turnover_value": "turnover_value",
    "negative_turnover_qty": "turnover_qty",
    "negative_deals_count": "deals_count",
    "negative_term_days": "term_days",
}


def _stacked(per_file: DataFrame, names: list[str]) -> DataFrame:
    stack = ", ".join(f"'{name}', `{name}`" for name in names)
    rows = per_file.selectExpr("file_key", f"stack({len(names)}, {stack}) AS (rule, violations)")
    return rows.where(F.col("violations") > 0)


def _sums(rules: dict[str, Column]) -> list[Column]:
    return [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name) for name, c in rules.items()]


def gate_from_parts(
    parts: DataFrame, min_year: int = 2000, max_currency_len: int = 10, instrument_type: str = DEFAULT_INSTRUMENT_TYPE,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Per archive file, the schema constraints its rows would violate (file_key, rule,
    violations), computed from the raw aggregate (no extra pass over raw).  A file with any
    violation is rejected whole.  ``rows`` (``cleaned_rows``) spare parts that are not kept the rules that
    need keys alone.

    * rows: a cell or header that cannot be loaded (``load_error``);
    * calendar days: year below ``min_year``;
    * instruments (one for each ticker of the file): currency code too long, negative term, type
      outside its domain, several tuples in one file;
    * facts, as the tables check them, after aggregation: negative values, sums beyond their
      column's range, several market segments for one (ticker, day).

    Tickers, issuers and currencies are never blank after cleaning, and every fact's parents come
    from the same rows, so those constraints cannot fail here; the ones on the file list and on
    raw row numbers are in ``gate_files`` and ``gate_row_numbers``."""
    from .normalize import instrument_tuples, per_file_facts

    rows = parts if rows is None else rows
    bad_rows = rows.groupBy("file_key").agg(F.sum("error_rows").cast("long").alias("load_error"))
    days = rows.where(F.year("trade_date") < min_year).select("file_key", "trade_date").distinct()
    days = days.groupBy("file_key").agg(F.count(F.lit(1)).alias("calendar_year_out_of_range"))
    tuples = instrument_tuples(parts, instrument_type)
    instrument = {
        "currency_code_too_long": F.length("currency_code") > max_currency_len,
        "negative_instrument_term_days": F.col("term_days") < 0,
        "instrument_type_unknown": ~F.col("instrument_type").isin(*INSTRUMENT_TYPES),
    }
    # Counted by ticker and by day first, so one pass gives the rules of single rows and those of rows side by side.
    tickers = tuples.groupBy("file_key", "ticker").agg(F.count(F.lit(1)).alias("n"), *_sums(instrument))
    tickers = tickers.groupBy("file_key").agg(*_sums({"instrument_conflict": F.col("n") > 1}), *[F.sum(c).alias(c) for c in instrument])
    fact = {name: F.col(c) < 0 for name, c in FACT_RULES.items()} | {
        "value_out_of_range": F.col("turnover_value").isNull() | F.col("turnover_qty").isNull() | F.col("deals_count").isNull()
        | ((F.col("p_cnt") > 0) & F.col("price_avg_weighted").isNull())
        | ((F.col("y_cnt") > 0) & F.col("yield_avg_pct").isNull())
    }
    keyed = per_file_facts(parts).groupBy("file_key", "ticker", "trade_date").agg(F.count(F.lit(1)).alias("n"), *_sums(fact))
    keyed = keyed.groupBy("file_key").agg(*_sums({"mixed_market_segment": F.col("n") > 1}), *[F.sum(c).alias(c) for c in fact])
    found = [
        _stacked(bad_rows, ["load_error"]),
        _stacked(days, ["calendar_year_out_of_range"]),
        _stacked(tickers, ["instrument_conflict", *instrument]),
        _stacked(keyed, ["mixed_market_segment", *fact]),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def gate_files(files: DataFrame, source_type: str) -> DataFrame:
    """Registry rules: file name and source type must not be blank."""
    blank = files.select("file_key", (F.btrim(F.coalesce("file_name", F.lit(""))) == "").cast("long").alias("blank_file_name"))
    blank = blank.withColumn("blank_source_type", F.lit(int(not source_type.strip())).cast("long"))
    return _stacked(blank, ["blank_file_name", "blank_source_type"])


def gate_row_numbers(raw: DataFrame) -> DataFrame:
    """Raw rules, where rows are numbered: numbers are positive and unique within a file.  Only files
    whose numbers are not proven to be 1..n are counted number by number."""
    n = _to_recheck(raw).groupBy("file_key", "row_num").agg(F.count(F.lit(1)).alias("n"))
    rules = {"row_num_not_positive": F.col("row_num") <= 0, "row_num_repeated": F.col("n") > 1}
    return _stacked(n.groupBy("file_key").agg(*_sums(rules)), list(rules))


def gate_violations(raw: DataFrame, min_year: int = 2000, max_currency_len: int = 10) -> DataFrame:
    from .normalize import cleaned_rows, daily_parts

    return gate_from_parts(daily_parts(raw), min_year, max_currency_len, rows=cleaned_rows(raw))
