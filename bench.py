"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Two modes, like the reference's own split between ETL and analyst pages:
* ``raw``: each query starts from the raw parquet tables (raw -> facts -> metrics -> query);
* ``stored``: the archive state is loaded once (timed as ``load``), then the analyst queries
  read the stored facts and the materialised summary.

Every timing is the median of 3 runs after one warm-up run, executed into Spark's ``noop`` sink
(full execution, nothing collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import uuid
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tradelake.operators import anomalies as A  # noqa: E402
from tradelake.operators import card as C  # noqa: E402
from tradelake.operators import compare as P  # noqa: E402
from tradelake.operators import loading as L  # noqa: E402
from tradelake.operators import screening as Q  # noqa: E402
from tradelake.plans import QUERIES  # noqa: E402
from tradelake.plans.registry import COMPARE_TICKERS, DATE_FROM, DATE_TO, reset  # noqa: E402
from tradelake.plans.warehouse import Warehouse  # noqa: E402
from tradelake.sources import testdata  # noqa: E402
from tradelake.session import build_session, ensure_checkpoint_dir  # noqa: E402

RAW_HEADLINE = [
    "daily_stats",
    "daily_metrics",
    "instrument_summary",
    "anomalies",
    "screener_filtered",
    "card_kpi",
    "comparison",
    "correlation",
    "price_index",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, before=None) -> float:
    """Median of the runs after a warm-up; ``before`` runs untimed ahead of each."""
    if before:
        before()
    fn()
    times = []
    for _ in range(RUNS):
        if before:
            before()  # from-raw runs: drop the cached raw aggregate, start from the parquet files
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 4), driver_memory="16g")
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    queries: dict[str, float] = {}

    for name in RAW_HEADLINE:
        queries[f"raw.{name}"] = timed(lambda n=name: run(QUERIES[n](spark, sf_dir)), before=reset)
    reset()

    # stored state goes to the shared folder named by spark.checkpoint.dir (a new one per run)
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    loads = iter(range(1000))
    holder = {}

    def load() -> None:
        built = Warehouse.from_testdata(spark, sf_dir, persist=True)
        holder["stored"] = built.materialize(os.path.join(scratch, f"state{next(loads)}"))
        built.release()

    # raw tables -> dimensions, facts, daily metrics and summary written (the ETL job)
    queries["stored.load"] = timed(load)

    # the load path: the archives from 1999 on, gated, on top of the published earlier ones
    raw = testdata.raw_trades(spark, sf_dir)
    key = F.col("file_key")
    files = L.files_of(raw).withColumn("file_order", key)
    roots = iter(range(1000))

    def load_part(root: str, part) -> None:
        state, _ = L.load_batch(L.read_state(spark, root), raw.where(part), files.where(part), gate_options={"min_year": 1900})
        L.publish(state, root)

    def base() -> None:
        holder["root"] = os.path.join(scratch, f"publish{next(roots)}")
        load_part(holder["root"], key < 199901)

    queries["stored.publish"] = timed(lambda: load_part(holder["root"], key >= 199901), before=base)
    stored = holder["stored"]
    m, cal = stored.metrics, stored.calendar
    stored_q = {
        "daily_metrics": lambda: run(m),
        "instrument_summary": lambda: run(stored.summary),
        "anomalies": lambda: run(A.anomalies(m)),
        "screener_filtered": lambda: run(
            Q.screen(Q.period_stats(m, cal, DATE_FROM, DATE_TO), Q.ScreenFilter(0.0, 1500.0))
        ),
        "card_kpi": lambda: run(C.card_kpis(m, cal, stored.instruments, DATE_FROM, DATE_TO)),
        "comparison": lambda: run(P.compare(m, cal, COMPARE_TICKERS, DATE_FROM, DATE_TO)),
        "correlation": lambda: run(
            P.correlation(P.compare_history(m, COMPARE_TICKERS, DATE_FROM, DATE_TO, ordered=False), COMPARE_TICKERS)
        ),
        "price_index": lambda: run(
            P.price_index(P.compare_history(m, COMPARE_TICKERS, DATE_FROM, DATE_TO, ordered=False), COMPARE_TICKERS)
        ),
        "tiers": lambda: run(Q.tiers(stored.summary)),
    }
    for name, fn in stored_q.items():
        queries[f"stored.{name}"] = timed(fn)

    total = round(sum(v for k, v in queries.items() if k.startswith("raw.")), 3)
    print(
        json.dumps(
            {
                "metric": "raw_headline_total_sec",
                "value": total,
                "unit": "sec",
                "queries": queries,
                "sf": sf,
                "cpus": cpus,
                "stored_total_sec": round(sum(v for k, v in queries.items() if k.startswith("stored.")), 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
