"""Raw archive rows derived from the TPC-H-style test tables.

Supplier = instrument, nation = issuer, line item = one raw trade row; one archive file per
ship month (or, for the overlap scenario, per order month).  All numeric inputs are exact
decimals built from the source columns; nothing is rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULT_MARKET_SEGMENT

# Columns that fix the source order of line items inside a file (no subset of them is unique).
SOURCE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Files below this size are read by one task or a few; the scan of such a table is dealt out anew.
SMALL_BYTES = 128 * 1024 * 1024


def spread_small(df: DataFrame, path: str) -> DataFrame:
    """Deal the rows of a table of one small file (its row group is one task) to all cores.  The
    table's size bounds what is shuffled; larger tables have splits of their own and stay as they are."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    small = fs.getContentSummary(folder).getLength() <= SMALL_BYTES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def archive_file_name(key: F.Column) -> F.Column:
    """``MarketStockResult_YYYY_MM.xlsx`` for a ``yyyymm`` key."""
    return F.format_string(
        "MarketStockResult_%04d_%02d.xlsx", (key / 100).cast("int"), (key % 100).cast("int")
    )


def raw_trades(
    spark: SparkSession,
    sf_dir: str,
    file_by: str = "ship",
    with_source_order: bool = False,
    dealt: bool = False,
) -> DataFrame:
    """Raw archive layer: ``file_key``, ``file_name`` and the 15 payload columns.

    ``file_by="ship"`` puts each row into the archive of its ship month, ``"order"`` into the
    archive of its order month (a (supplier, day) then appears in several files).  ``dealt``: the rows
    of an archive lie in one partition; the columns of the tables are dealt out, half the bytes of the payload.
    """
    li = spread_small(table(spark, sf_dir, "lineitem"), f"{sf_dir.rstrip('/')}/lineitem.parquet")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey)
    if file_by == "ship":
        month_of = F.col("l_shipdate")
    elif file_by == "order":
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey)
        month_of = F.col("o_orderdate")
    else:
        raise ValueError(f"file_by must be 'ship' or 'order', not {file_by!r}")

    ep = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    qty = F.col("l_quantity").cast("decimal(6,0)")
    key = (F.year(month_of) * 100 + F.month(month_of)).cast("long")
    if dealt:
        df = df.repartition(key)
    cols = [
        key.alias("file_key"),
        archive_file_name(key).alias("file_name"),
        F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")).alias("ticker_raw"),
        F.col("n_name").alias("issuer_name_raw"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit("  ")).otherwise(F.lit("USD")).alias("currency_code_raw"),
        (ep * (F.lit(1) - disc)).cast("decimal(18,6)").alias("price_min_raw"),
        F.col("l_extendedprice").cast("decimal(18,6)").alias("price_avg_raw"),
        (ep * (F.lit(1) + tax)).cast("decimal(18,6)").alias("price_aux_raw"),
        (disc * 100).cast("decimal(12,6)").alias("yield_min_raw"),
        ((disc + tax) * 100).cast("decimal(12,6)").alias("yield_max_raw"),
        ((disc + tax) * 50).cast("decimal(12,6)").alias("yield_avg_raw"),
        (ep * qty).cast("decimal(20,2)").alias("turnover_value_raw"),
        F.col("l_quantity").cast("decimal(20,6)").alias("turnover_qty_raw"),
        F.col("l_linenumber").cast("int").alias("deals_count_raw"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(None).cast("int"))
        .otherwise((F.lit(30) + F.col("s_suppkey") % 10).cast("int"))
        .alias("term_days_raw"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("trade_datetime_raw"),
        F.lit(DEFAULT_MARKET_SEGMENT).alias("market_segment_raw"),
    ]
    if with_source_order:
        cols += [F.col(c) for c in SOURCE_ORDER]
    return df.select(*cols)


def archive_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_key, file_name of every calendar month from the first to the last ship date, also of
    months without rows."""
    li = table(spark, sf_dir, "lineitem")
    bounds = li.agg(
        F.trunc(F.min("l_shipdate").cast("date"), "month").alias("lo"), F.trunc(F.max("l_shipdate").cast("date"), "month").alias("hi")
    )
    months = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    key = (F.year("m") * 100 + F.month("m")).cast("long")
    return months.select(key.alias("file_key"), archive_file_name(key).alias("file_name"))
