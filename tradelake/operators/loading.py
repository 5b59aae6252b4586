"""Import registry, incremental load decisions, replace mode, batch publish and manifest.

State lives in plain parquet.  A load appends its raw rows, writes the months of facts it touches
into new folders, and only then adds a numbered pointer file, so readers never see a half-written
load and a failed load leaves the previous state in place (the per-file transaction of the
reference).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_SOURCE_TYPE, FILE_PERIOD, LOAD_NOTE
from ..session import ensure_checkpoint_dir, tasks_for
from . import refresh as R


# --- L1 ---------------------------------------------------------------------------------------
def register_files(
    file_list: DataFrame,
    raw: DataFrame,
    source_type: str = DEFAULT_SOURCE_TYPE,
    notes: str | None = LOAD_NOTE,
    loaded_at: dt.datetime | None = None,
) -> DataFrame:
    """Registry rows for ``file_list`` (file_key, file_name): rows_count from the raw layer;
    files without rows are registered with 0."""
    if "n_rows" in raw.columns:  # the raw aggregate
        counts = raw.groupBy("file_key").agg(F.sum("n_rows").cast("int").alias("rows_count"))
    else:
        counts = raw.groupBy("file_key").agg(F.count(F.lit(1)).cast("int").alias("rows_count"))
    ts = F.lit(loaded_at).cast("timestamp_ntz") if loaded_at else F.localtimestamp()
    order = F.col("file_order") if "file_order" in file_list.columns else F.col("file_key").alias("file_order")
    return file_list.select("file_key", "file_name", order).join(counts, "file_key", "left").select(
        "file_key",
        "file_name",
        "file_order",
        F.lit(source_type).alias("source_type"),
        ts.alias("loaded_at"),
        F.coalesce("rows_count", F.lit(0)).alias("rows_count"),
        F.lit(notes).cast("string").alias("notes"),
    )


def files_of(raw: DataFrame) -> DataFrame:
    return raw.select("file_key", "file_name").distinct()


# --- L2 ---------------------------------------------------------------------------------------
def load_plan(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Default mode: a candidate whose name is registered is skipped; report the latest
    registered id of that name (loaded_at desc, file id desc)."""
    latest = registry.groupBy("file_name").agg(
        F.max_by("file_key", F.struct("loaded_at", "file_key")).alias("existing_file_key")
    )
    return candidates.select("file_key", "file_name").join(latest, "file_name", "left").select(
        "file_name",
        "file_key",
        F.when(F.col("existing_file_key").isNull(), F.lit("load")).otherwise(F.lit("skip")).alias("action"),
        "existing_file_key",
    )


def new_files(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    return candidates.join(registry.select("file_name"), "file_name", "left_anti")


# --- L3 ---------------------------------------------------------------------------------------
@dataclass
class Delta:
    """What a load adds to the state it was built on: raw rows, the months of facts it touches, and
    the first day it changes of each ticker."""

    raw: DataFrame
    months: DataFrame  # month (yyyymm)
    changed: DataFrame  # ticker, first_day
    staged: tuple[str, str] | None = None  # root and load under which the raw rows are written already


@dataclass
class ArchiveState:
    registry: DataFrame
    raw: DataFrame
    issuers: DataFrame
    instruments: DataFrame
    calendar: DataFrame
    facts: DataFrame
    cached: tuple = ()  # persisted intermediates, released by ``publish``
    delta: Delta | None = None  # set by ``load_batch``
    base: int | None = None  # pointer number of the published state this one extends
    run: int = 0  # number of the last run that loaded files; files of a run are ranked by name


class RejectedArchive(RuntimeError):
    """The first archive that the gate rejected; archives before it are loaded."""


def replace_files(state: ArchiveState, names: DataFrame) -> ArchiveState:
    """Replace mode: registry rows of these names go, their raw rows go with them (cascade),
    facts they produced stay with ``file_key = NULL`` until a reload overwrites them;
    dimensions are untouched."""
    gone = state.registry.join(names.select("file_name"), "file_name", "left_semi").select("file_key")
    registry = state.registry.join(names.select("file_name"), "file_name", "left_anti")
    raw = state.raw.join(F.broadcast(gone), "file_key", "left_anti")  # a row for each file: rows and facts stay where they are
    flagged = F.broadcast(gone.select("file_key", F.lit(True).alias("_gone")))
    cleared = {c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) for c in ("file_key", "file_rank") if c in state.facts.columns}
    facts = state.facts.join(flagged, "file_key", "left").withColumns(cleared).drop("_gone")
    return replace(state, registry=registry, raw=raw, facts=facts.select(*state.facts.columns))


def _month(date) -> Column:
    return F.year(date) * 100 + F.month(date)


def _stage_raw(raw: DataFrame, root: str, load: str) -> DataFrame:
    """Raw rows written to the folder of their load, and read back: what derives from them reads the columns it
    needs there.  No pointer names the load yet, and no registry the rejected files in it."""
    folder = f"{root}/raw_market_archive/load={load}"
    raw.write.partitionBy("file_key").parquet(folder)
    return raw.sparkSession.read.schema(raw.schema).parquet(folder).select(*raw.columns)


# --- L4: batch load ---------------------------------------------------------------------------
def load_batch(
    state: ArchiveState | None,
    raw: DataFrame,
    files: DataFrame,
    *,
    replace: bool = False,
    source_type: str = DEFAULT_SOURCE_TYPE,
    notes: str | None = LOAD_NOTE,
    loaded_at: dt.datetime | None = None,
    gate_options: dict | None = None,
    run: int | None = None,
    stage: str | None = None,
) -> tuple[ArchiveState, DataFrame]:
    """Load archive files in name order on top of ``state`` (``None`` = empty).

    Every file has a rank: the number of its run, then its name.  Facts and instruments carry the
    rank of the file they come from, and the greater rank wins, stored or new.  A load is a run of
    its own by default, so it wins over earlier ones; all micro-batches of a stream are one ``run``,
    so their result is that of one load of all files, in whatever order they arrive.

    Default mode skips names already registered.  Each file is validated by the gate; the first
    rejected file aborts the run: earlier files are loaded, it and later files are not (the
    reference's per-file transaction + abort).  ``replace`` detaches (L3) the names that are loaded
    by this run, and no other.  Files are numbered on from the state's last ``file_order``, so a
    later load wins over an earlier one also when facts are rebuilt from the raw layer.  ``stage``: the
    root that the load will be published to.  There the raw rows are written first, so archives are parsed
    once, whatever is derived from their rows, and ``publish`` finds them written.
    Returns the new state (lazy) and a per-file report (file_name, file_key, status)."""
    from pyspark import StorageLevel

    from .normalize import (
        calendar_from_parts,
        daily_parts,
        finished_parts,
        issuers_from_parts,
        upsert_daily_stats,
        upsert_instruments,
    )
    from .quality import gate_files, gate_from_parts, gate_row_numbers

    done = 0 if state is None else state.registry.agg(F.max("file_order")).first()[0] or 0
    run = run or (1 if state is None else state.run + 1)
    # A row for each file, kept: listed once, and sent to the rows rather than the rows to it.
    ensure_checkpoint_dir(files.sparkSession)
    files = files.select("file_key", "file_name", (F.col("file_order") + done).alias("file_order")).checkpoint()
    ranks = files.select("file_key", F.format_string("%012d/%s", F.lit(run), "file_name").alias("file_rank"))
    candidates = files if state is None or replace else new_files(files, state.registry)
    raw = raw.drop("file_order", "file_name").join(F.broadcast(candidates), "file_key")
    staged = None
    if stage is not None:
        staged = (stage.rstrip("/"), uuid.uuid4().hex)
        raw = _stage_raw(raw, *staged)
    # One pass over the raw rows feeds the gate, the registry counts, dimensions and facts.
    tasks = tasks_for(raw)
    parts = finished_parts(daily_parts(raw, tasks=tasks)).persist(StorageLevel.MEMORY_AND_DISK)
    found = gate_from_parts(parts, **(gate_options or {})).unionByName(gate_files(candidates, source_type))
    if "row_num" in raw.columns:
        found = found.unionByName(gate_row_numbers(raw))
    # The only value the driver needs: the first rejected file (files load in name order).
    first_bad = found.join(candidates, "file_key").agg(F.min("file_order")).first()[0]
    good = F.lit(True) if first_bad is None else F.col("file_order") < first_bad
    ok, parts_ok = candidates.where(good), parts.where(good)
    raw_ok = raw.where(good).drop("load_error")
    if state is not None and replace:
        touched = state.registry.join(ok.select("file_name"), "file_name", "left_semi").select("file_key")
        state_months = state.facts.join(F.broadcast(touched), "file_key", "left_semi").select(_month("trade_date").alias("month"))
        state = replace_files(state, ok.select("file_name"))
    else:
        state_months = None
    months = parts_ok.where(F.col("trade_date").isNotNull()).select(_month("trade_date").alias("month"))
    months = (months if state_months is None else months.unionByName(state_months)).distinct()

    facts_of = F.col("ticker").isNotNull() & F.col("issuer_name").isNotNull() & F.col("trade_date").isNotNull()
    changed = parts_ok.where(facts_of).groupBy("ticker").agg(F.min("trade_date").alias("first_day"))
    reg_new = register_files(ok, parts_ok, source_type, notes, loaded_at).join(ranks, "file_key")
    if state is None:
        new_state = ArchiveState(
            reg_new,
            raw_ok,
            issuers_from_parts(parts_ok),
            upsert_instruments(parts_ok, ranks),
            calendar_from_parts(parts_ok),
            upsert_daily_stats(parts_ok, ranks),
            (parts,),
            Delta(raw_ok, months, changed, staged),
            run=run,
        )
    else:
        new_state = ArchiveState(
            state.registry.unionByName(reg_new, allowMissingColumns=True),
            state.raw.unionByName(raw_ok, allowMissingColumns=True),
            issuers_from_parts(parts_ok, state.issuers),
            upsert_instruments(parts_ok, ranks, state.instruments),
            calendar_from_parts(parts_ok, state.calendar),
            # Small stored facts are dealt to the new ones' partitions; large ones are left to Spark's own shuffle.
            upsert_daily_stats(parts_ok, ranks, state.facts, tasks if tasks_for(state.facts) <= tasks else None),
            (parts,) + tuple(state.cached),
            Delta(raw_ok, months, changed, staged),
            state.base,
            max(run, state.run),
        )
    status = (
        F.when(F.col("skipped"), F.lit("skipped"))
        .when(F.lit(first_bad).isNull() | (F.col("file_order") < F.lit(first_bad)), F.lit("loaded"))
        .when(F.col("file_order") == F.lit(first_bad), F.lit("rejected"))
        .otherwise(F.lit("aborted"))
    )
    cand_flag = candidates.select("file_key", F.lit(False).alias("skipped"))
    report = (
        files.join(cand_flag, "file_key", "left")
        .withColumn("skipped", F.coalesce("skipped", F.lit(True)))
        .select("file_name", "file_key", (F.col("file_order") - done).alias("file_order"), status.alias("status"))
        .orderBy("file_order")
    )
    return new_state, report


def rebuilt_facts(state: ArchiveState) -> DataFrame:
    """The facts derived anew from the raw layer, files in the order of their ranks (detached facts of
    replaced files, which the raw layer no longer holds, are not among them)."""
    from .normalize import build_daily_stats

    rank = F.col("file_rank") if "file_rank" in state.registry.columns else F.lit(None).cast("string")
    order = Window.orderBy(F.coalesce(rank, F.lit("")), "file_order")  # one row for each file
    numbers = state.registry.select("file_key", F.row_number().over(order).cast("long").alias("file_order"))
    return build_daily_stats(state.raw.drop("file_order").join(F.broadcast(numbers), "file_key"))


# --- publish ----------------------------------------------------------------------------------
#   raw_market_archive/load=<id>/file_key=<k>   written once, never rewritten
#   market_daily_stats/load=<id>/month=<m>      only the months a load touches
#   tables/<id>/<name>                          registry, dimensions and the summary (small)
#   summary_state/load=<id>/version=<n>         state rows of the summary that a publish computed
#   pointers/<number>.json                      one for each publish; the highest is the state
# A load's folders carry a random id, so a failed attempt leaves only files that no pointer names.
SMALL_TABLES = {"import_files": "registry", "issuers": "issuers", "instruments": "instruments", "trading_calendar": "calendar"}


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem of ``path`` (local, HDFS, object stores alike)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The highest pointer under ``root``: number, load, months (month -> load), loads of raw rows
    (file_key -> load is in the registry), schemas, epochs of streams.  None: nothing published."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/pointers")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return None
    path = f"{root.rstrip('/')}/pointers/{max(numbers):012d}.json"
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_pointer(spark: SparkSession, root: str, pointer: dict) -> None:
    """A new numbered file: written under another name, then renamed.  An earlier pointer stays as
    it is, so readers always find a complete one."""
    name = f"{root.rstrip('/')}/pointers/{pointer['number']:012d}.json"
    fs, tmp = _fs(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    _, final = _fs(spark, name)
    fs.mkdirs(final.getParent())
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(pointer).encode("utf-8")))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(tmp, final):
        raise OSError(f"{name} was published by another writer")


def _days_of(months: list[int]) -> Column:
    """Days of these months, as ranges that reach the scan of the stored facts."""
    day = F.col("trade_date")
    first = lambda m: F.make_date(F.lit(m // 100), F.lit(m % 100), F.lit(1))
    spans = [(m, m) for m in months] if len(months) <= 24 else [(min(months), max(months))]
    out = F.lit(False)
    for a, b in spans:
        out = out | ((day >= first(a)) & (day <= F.last_day(first(b))))
    return out


MONTH_FILES = 8  # at most as many files hold a month's facts of a load


def _written_months(spark: SparkSession, folder: str) -> list[int]:
    """Months (yyyymm) of the folders that a write of facts left."""
    fs, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[6:]) for n in names if n.startswith("month="))


def publish(
    state: ArchiveState, root: str, stream: str | None = None, epoch: int | None = None, summary: bool | None = None
) -> int:
    """Add the load that made ``state`` to the state stored under ``root``; returns the pointer's
    number.  Raw rows are appended (unless the load staged them), only touched months of facts are written anew, and the
    pointer comes last.  ``stream`` and ``epoch`` mark a finished micro-batch.  A stored summary is
    refreshed from what the load changed (``summary``: True stores one if there is none yet, False
    drops it)."""
    spark, root = state.facts.sparkSession, root.rstrip("/")
    before = read_pointer(spark, root) or {"number": 0, "months": {}, "epochs": {}}
    if state.base is not None and state.base != before["number"]:
        raise OSError(f"the state under {root} is newer than the one this load was built on")
    fresh = state.delta is None or not before["number"]
    raw = state.raw if fresh else state.delta.raw
    if state.delta is not None and raw is state.delta.raw and state.delta.staged and state.delta.staged[0] == root:
        load = state.delta.staged[1]
    else:
        load = uuid.uuid4().hex
        raw.write.partitionBy("file_key").parquet(f"{root}/raw_market_archive/load={load}")
    facts = state.facts.withColumn("month", _month("trade_date"))
    touched = set()
    if not fresh:
        touched = {r["month"] for r in state.delta.months.collect()}  # calendar months
        facts = facts.where(F.col("month").isin(sorted(touched)) & _days_of(sorted(touched)))
    deal = F.pmod(F.hash("ticker"), F.lit(MONTH_FILES))
    facts = facts.repartition("month", deal).sortWithinPartitions("month", "ticker", "trade_date")
    folder = f"{root}/market_daily_stats/load={load}"
    facts.write.partitionBy("month").parquet(folder)
    months = _written_months(spark, folder)  # of the months touched, those that hold facts
    registry = state.registry
    if "load" not in registry.columns:
        registry = registry.withColumn("load", F.lit(None).cast("string"))
    registry = registry.withColumn("load", F.coalesce("load", F.lit(load)))
    for name, attr in SMALL_TABLES.items():
        df = registry if attr == "registry" else getattr(state, attr)
        df.write.parquet(f"{root}/tables/{load}/{name}")
    kept = {} if fresh else {m: x for m, x in before["months"].items() if int(m) not in touched}
    stored = kept | {str(m): load for m in months}
    kept_summary = None if fresh else before.get("summary")
    summary_now = None
    if summary or (summary is None and before.get("summary")):
        summary_now = _refresh_summary(spark, root, load, before["number"] + 1, state, stored, kept_summary)
    for df in state.cached:
        df.unpersist()
    schemas = {name: getattr(state, attr).schema.json() for name, attr in SMALL_TABLES.items()}
    schemas |= {"import_files": registry.schema.json(), "market_daily_stats": state.facts.schema.json(), "raw_market_archive": state.raw.schema.json()}
    epochs = before["epochs"] | ({stream: epoch} if stream is not None and epoch is not None else {})
    runs = before.get("runs", {}) | ({stream: before.get("runs", {}).get(stream, state.run)} if stream is not None else {})
    pointer = {
        "number": before["number"] + 1, "load": load, "months": stored, "epochs": epochs, "schemas": schemas,
        "run": state.run, "runs": runs, "summary": summary_now,
    }
    write_pointer(spark, root, pointer)
    return pointer["number"]


def _facts_of_months(spark: SparkSession, root: str, schema: T.StructType, months: dict[str, str]) -> DataFrame:
    """Stored facts of these months (month -> load)."""
    if not months:
        return spark.createDataFrame([], schema)
    stats = f"{root}/market_daily_stats"
    paths = [f"{stats}/load={load}/month={month}" for month, load in sorted(months.items())]
    return spark.read.schema(schema).option("basePath", stats).parquet(*paths).select(*schema.names)


SUMMARY_VERSIONS = 16  # versions of summary state before they are merged into one


def _summary_state(spark: SparkSession, root: str, stored: dict) -> DataFrame:
    """Stored state rows, all versions of them."""
    schema = T.StructType([*T.StructType.fromJson(json.loads(stored["schema"])).fields, T.StructField("version", T.LongType())])
    base = f"{root}/summary_state"
    paths = [f"{base}/load={load}/version={v}" for load, v in stored["versions"]]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def _refresh_summary(spark, root: str, load: str, number: int, state: ArchiveState, stored: dict, before: dict | None) -> dict:
    """Write the state rows that this load changes and the summary; returns their entry of the pointer.
    Without a summary before, the state is computed from all stored facts."""
    schema = state.facts.schema
    first = None
    if before is not None and state.delta is not None:
        first = state.delta.changed.agg(R.month_of(F.min("first_day"))).first()[0]
        versions = list(before["versions"])
        old = _summary_state(spark, root, before)
        if first is not None:
            later = {m: x for m, x in stored.items() if int(m) >= first}
            facts = R.suffix(_facts_of_months(spark, root, schema, later), state.delta.changed)
            rows = R.state_rows(facts, R.seeds(old, state.delta.changed))
    else:
        versions, old = [], None
        rows = R.state_rows(_facts_of_months(spark, root, schema, stored))
    entry = {"versions": versions, "schema": before["schema"] if before else rows.schema.json()}
    if old is None or first is not None:
        rows.write.parquet(f"{root}/summary_state/load={load}/version={2 * number}")
        entry["versions"] = [*versions, [load, 2 * number]]
    if len(entry["versions"]) > SUMMARY_VERSIONS:
        R.latest_rows(_summary_state(spark, root, entry)).write.parquet(f"{root}/summary_state/load={load}/version={2 * number + 1}")
        entry["versions"] = [[load, 2 * number + 1]]
    summary = R.summary_of(_summary_state(spark, root, entry), state.instruments, state.issuers)
    summary.write.parquet(f"{root}/tables/{load}/mv_instrument_summary")
    return entry | {"load": load, "columns": summary.schema.json()}


def read_summary(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored summary as of the last publish; None if none is stored."""
    root, pointer = root.rstrip("/"), read_pointer(spark, root)
    if pointer is None or not pointer.get("summary"):
        return None
    stored = pointer["summary"]
    schema = T.StructType.fromJson(json.loads(stored["columns"]))
    return spark.read.schema(schema).parquet(f"{root}/tables/{stored['load']}/mv_instrument_summary")


def stream_run(spark: SparkSession, root: str, stream: str) -> int | None:
    """Number of the run that a stream's micro-batches belong to; None before the first."""
    pointer = read_pointer(spark, root)
    return None if pointer is None else pointer.get("runs", {}).get(stream)


def read_state(spark: SparkSession, root: str) -> ArchiveState | None:
    """The published state.  Tables are read with their stored schemas (an empty one too).  Raw
    rows count if the registry names their load for their file."""
    root, pointer = root.rstrip("/"), read_pointer(spark, root)
    if pointer is None:
        return None
    schema = {k: T.StructType.fromJson(json.loads(v)) for k, v in pointer["schemas"].items()}
    small = {
        attr: spark.read.schema(schema[name]).parquet(f"{root}/tables/{pointer['load']}/{name}")
        for name, attr in SMALL_TABLES.items()
    }
    base, raw_schema = f"{root}/raw_market_archive", schema["raw_market_archive"]
    raw = spark.read.schema(T.StructType([*raw_schema.fields, T.StructField("load", T.StringType())])).parquet(base)
    raw = raw.join(F.broadcast(small["registry"].select("file_key", "load")), ["file_key", "load"], "left_semi").select(*raw_schema.names)
    facts = _facts_of_months(spark, root, schema["market_daily_stats"], pointer["months"])
    run = pointer.get("run", pointer["number"])
    return ArchiveState(raw=raw, facts=facts, base=pointer["number"], run=run, **small)


# --- L7 ---------------------------------------------------------------------------------------
def archive_manifest(raw: DataFrame, file_list: DataFrame | None = None) -> DataFrame:
    """Per archive: period (from the file name, NULL without one), rows and distinct trade days
    (0, 0 for an empty archive).  Accepts the raw layer or its aggregate (``daily_parts``)."""
    if "n_rows" in raw.columns:
        rows, days = F.sum("n_rows"), F.countDistinct("trade_date")
    else:
        rows, days = F.count(F.lit(1)), F.countDistinct(F.to_date("trade_datetime_raw"))
    stats = raw.groupBy("file_key").agg(
        rows.cast("long").alias("rows_count"), days.cast("long").alias("trade_days_in_file")
    )
    files = file_list if file_list is not None else files_of(raw)
    period = lambda i: F.regexp_extract("file_name", FILE_PERIOD, i)
    return files.join(stats, "file_key", "left").select(
        F.col("file_name").alias("archive_file"),
        F.when(period(1) != "", F.concat(period(1), F.lit("-"), period(2))).alias("period_month"),
        F.coalesce("rows_count", F.lit(0)).alias("rows_count"),
        F.coalesce("trade_days_in_file", F.lit(0)).alias("trade_days_in_file"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """``;``-separated CSV with a header, one file."""
    manifest.orderBy("archive_file").coalesce(1).write.mode("overwrite").option("sep", ";").option(
        "header", True
    ).csv(path)
