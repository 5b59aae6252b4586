"""The analytic state: raw layer, dimensions, facts and the derived lazy views.

A ``Warehouse`` only holds DataFrames; building one runs nothing.  ``from_testdata`` derives
everything from the TPC-H-style tables, ``from_raw`` from any raw layer (archive scan, stream
batch), ``materialize`` writes the tables once so that analyst queries read stored facts, as
the reference's pages read PostgreSQL tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import anomalies as A
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators.loading import read_pointer, write_pointer
from ..session import tasks_for
from ..sources import testdata


@dataclass(eq=False)
class Warehouse:
    spark: SparkSession
    raw: DataFrame | None
    issuers: DataFrame
    instruments: DataFrame
    calendar: DataFrame
    facts: DataFrame
    files: DataFrame | None = None
    parts: DataFrame | None = field(default=None, repr=False)
    tasks: int | None = None  # partitions of shuffles that hold a row for each fact
    _summary: DataFrame | None = field(default=None, repr=False)
    _metrics: DataFrame | None = field(default=None, repr=False)

    # --- constructors -------------------------------------------------------------------------
    @classmethod
    def from_raw(
        cls, spark: SparkSession, raw: DataFrame, files: DataFrame | None = None, persist: bool = False
    ) -> "Warehouse":
        """Derive the state from a raw layer.  All tables come from one compact aggregate of
        the raw rows (``daily_parts``); with ``persist`` it is kept (memory, then disk) so the
        raw layer is read once for all of them.  Lost cached blocks are recomputed.  Without it each
        table is a pass of its own over the columns it needs, and dimensions come from the rows."""
        tasks = tasks_for(raw)
        parts = N.daily_parts(raw, tasks=tasks)
        if persist:
            parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
        keys = parts if persist else N.cleaned_rows(raw)
        return cls(
            spark=spark,
            raw=raw,
            issuers=N.issuers_from_parts(keys),
            instruments=N.instruments_from_parts(keys),
            calendar=N.calendar_from_parts(keys),
            facts=N.facts_from_parts(parts),
            files=files,
            parts=parts,
            tasks=tasks,
        )

    @classmethod
    def from_testdata(
        cls, spark: SparkSession, sf_dir: str, file_by: str = "ship", persist: bool = False
    ) -> "Warehouse":
        return cls.from_raw(spark, testdata.raw_trades(spark, sf_dir, file_by), persist=persist)

    def release(self) -> None:
        """Drop the cached raw aggregate (if any)."""
        if self.parts is not None and self.parts.storageLevel.useMemory | self.parts.storageLevel.useDisk:
            self.parts.unpersist()

    @classmethod
    def from_path(cls, spark: SparkSession, path: str) -> "Warehouse":
        """The latest version that ``materialize`` finished under ``path``."""
        pointer = read_pointer(spark, path)
        if pointer is None:
            raise FileNotFoundError(f"nothing is materialised under {path}")
        read = lambda name: spark.read.parquet(f"{path}/{pointer['load']}/{name}")
        return cls(
            spark=spark,
            raw=None,
            issuers=read("issuers"),
            instruments=read("instruments"),
            calendar=read("trading_calendar"),
            facts=read("market_daily_stats"),
            _summary=read("instrument_summary") if pointer["summary"] else None,
            _metrics=read("daily_metrics") if pointer["summary"] else None,
        )

    def materialize(self, path: str, with_summary: bool = True) -> "Warehouse":
        """Write dimensions and facts, and a new version each time, so a warehouse that reads
        ``path`` can be materialised there again; returns a warehouse reading the new version.
        Facts are dealt out by ticker and sorted by ticker and date inside each file, so ticker and date
        predicates prune row groups."""
        number = (read_pointer(self.spark, path) or {"number": 0})["number"] + 1
        load = f"v{number}-{uuid.uuid4().hex}"
        base = f"{path}/{load}"
        self.issuers.write.parquet(f"{base}/issuers")
        self.instruments.write.parquet(f"{base}/instruments")
        self.calendar.write.parquet(f"{base}/trading_calendar")
        self.facts.repartition("ticker").sortWithinPartitions("ticker", "trade_date").write.parquet(f"{base}/market_daily_stats")
        if with_summary:
            # Materialised views: daily metrics (returns over full history, sorted by ticker and
            # date) and the instrument summary, derived from the facts just written.
            read = lambda name: self.spark.read.parquet(f"{base}/{name}")
            m = M.daily_metrics(read("market_daily_stats"), read("instruments"), read("issuers"))
            m.sortWithinPartitions("ticker", "trade_date").write.parquet(f"{base}/daily_metrics")
            M.save_summary(M.instrument_summary(read("daily_metrics")), f"{base}/instrument_summary")
        write_pointer(self.spark, path, {"number": number, "load": load, "summary": with_summary})
        return Warehouse.from_path(self.spark, path)

    # --- derived views (lazy) -----------------------------------------------------------------
    @cached_property
    def metrics(self) -> DataFrame:
        if self._metrics is not None:
            return self._metrics
        if self.parts is not None:  # descriptors come along with the facts: one pass over raw
            return M.add_daily_metrics(M.described(N.described_facts(self.parts, tasks=self.tasks)))
        return M.daily_metrics(self.facts, self.instruments, self.issuers)

    @property
    def summary(self) -> DataFrame:
        return self._summary if self._summary is not None else M.instrument_summary(self.metrics)

    @cached_property
    def anomalies(self) -> DataFrame:
        return A.anomalies(self.metrics)
