"""Registry, skip / replace modes, gate, batch load and snapshot publish, manifest, checks."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradelake.operators import loading as L
from tradelake.operators import normalize as N
from tradelake.operators import quality as D
from tradelake.operators.rownum import with_row_number
from tradelake.plans.warehouse import Warehouse

from .conftest import make_raw, raw_row


def files_df(spark, names):
    return spark.createDataFrame(
        [(k, n, i + 1) for i, (k, n) in enumerate(names)], "file_key long, file_name string, file_order long"
    )


def test_register_counts_and_empty_file(spark):
    raw = make_raw(spark, [raw_row(file_key=1), raw_row(file_key=1)])
    reg = L.register_files(files_df(spark, [(1, "f001.xlsx"), (2, "f002.xlsx")]), raw).collect()
    assert {(r.file_name, r.rows_count) for r in reg} == {("f001.xlsx", 2), ("f002.xlsx", 0)}


def test_skip_already_loaded_reports_latest_id(spark):
    reg = spark.createDataFrame(
        [(1, "a.xlsx", dt.datetime(2024, 1, 1)), (5, "a.xlsx", dt.datetime(2024, 2, 1)), (3, "a.xlsx", dt.datetime(2024, 2, 1))],
        "file_key long, file_name string, loaded_at timestamp_ntz",
    )
    cand = spark.createDataFrame([(9, "a.xlsx"), (10, "b.xlsx")], "file_key long, file_name string")
    plan = {r.file_name: (r.action, r.existing_file_key) for r in L.load_plan(cand, reg).collect()}
    assert plan == {"a.xlsx": ("skip", 5), "b.xlsx": ("load", None)}


def _state(spark, raw, files):
    st, report = L.load_batch(None, raw, files, gate_options={"min_year": 2000})
    return st, {r.file_name: r.status for r in report.collect()}


def test_batch_load_gate_aborts_at_first_bad_file(spark):
    raw = make_raw(
        spark,
        [
            raw_row(file_key=1, file_name="f1.xlsx"),
            raw_row(file_key=2, file_name="f2.xlsx", currency_code_raw="EUR"),
            raw_row(file_key=2, file_name="f2.xlsx", currency_code_raw="USD"),
            raw_row(file_key=3, file_name="f3.xlsx", trade_datetime_raw=dt.datetime(2024, 1, 5)),
        ],
    )
    st, status = _state(spark, raw, files_df(spark, [(1, "f1.xlsx"), (2, "f2.xlsx"), (3, "f3.xlsx")]))
    assert status == {"f1.xlsx": "loaded", "f2.xlsx": "rejected", "f3.xlsx": "aborted"}
    assert [r.file_name for r in st.registry.collect()] == ["f1.xlsx"]
    assert st.facts.count() == 1


def test_rerun_without_replace_skips_and_replace_detaches(spark):
    raw1 = make_raw(
        spark,
        [
            raw_row(file_key=1, file_name="f1.xlsx", trade_datetime_raw=dt.datetime(2024, 1, 2), turnover_value_raw=100),
            raw_row(file_key=1, file_name="f1.xlsx", trade_datetime_raw=dt.datetime(2024, 1, 3), turnover_value_raw=7),
        ],
    )
    files = files_df(spark, [(1, "f1.xlsx")])
    st, _ = L.load_batch(None, raw1, files)
    # same name again, default mode: skipped, nothing changes
    st2, rep = L.load_batch(st, raw1, files)
    assert [r.status for r in rep.collect()] == ["skipped"]
    assert st2.facts.count() == 2 and st2.registry.count() == 1
    # replace with a shorter file: the missing day keeps its fact with NULL provenance
    raw2 = make_raw(spark, [raw_row(file_key=11, file_name="f1.xlsx", trade_datetime_raw=dt.datetime(2024, 1, 2), turnover_value_raw=40)])
    st3, rep3 = L.load_batch(st, raw2, files_df(spark, [(11, "f1.xlsx")]), replace=True)
    assert [r.status for r in rep3.collect()] == ["loaded"]
    facts = {r.trade_date: (r.turnover_value, r.file_key) for r in st3.facts.collect()}
    assert facts[dt.date(2024, 1, 2)] == (Decimal("40.00"), 11)
    assert facts[dt.date(2024, 1, 3)] == (Decimal("7.00"), None)
    assert [r.file_key for r in st3.registry.collect()] == [11]
    assert st3.raw.where(F.col("file_key") == 1).count() == 0


def test_replace_detaches_only_what_is_loaded(spark):
    """f1 good, f2 rejected, f3 not reached: f2 and f3 stay as they were."""
    old = [raw_row(file_key=k, file_name=f"f{k}.xlsx", trade_datetime_raw=dt.datetime(2024, k, 2)) for k in (1, 2, 3)]
    names = [(k, f"f{k}.xlsx") for k in (1, 2, 3)]
    st, _ = L.load_batch(None, make_raw(spark, old), files_df(spark, names))
    new = [raw_row(file_key=k, file_name=f"f{k}.xlsx", trade_datetime_raw=dt.datetime(2024, k, 2), turnover_value_raw=55) for k in (1, 2, 3)]
    new.append(raw_row(file_key=2, file_name="f2.xlsx", currency_code_raw="EUR"))
    st2, rep = L.load_batch(st, make_raw(spark, new), files_df(spark, names), replace=True)
    assert {r.file_name: r.status for r in rep.collect()} == {"f1.xlsx": "loaded", "f2.xlsx": "rejected", "f3.xlsx": "aborted"}
    assert st2.raw.count() == 3 and st2.registry.count() == 3
    facts = {r.file_key: r.turnover_value for r in st2.facts.collect()}
    assert facts == {1: Decimal("55.00"), 2: Decimal("100.00"), 3: Decimal("100.00")}


def test_one_bad_file_does_not_hurt_the_ones_before_it(spark):
    raw = make_raw(spark, [raw_row(file_key=1, file_name="a"), raw_row(file_key=2, file_name="b")])
    raw = raw.withColumn("load_error", F.when(F.col("file_key") == 2, F.lit("number out of range in price_min_raw")))
    st, rep = L.load_batch(None, raw, files_df(spark, [(1, "a"), (2, "b")]))
    assert [r.status for r in rep.collect()] == ["loaded", "rejected"]
    assert st.facts.count() == 1 and "load_error" not in st.raw.columns


def test_rows_that_are_fine_after_aggregation_are_accepted(spark):
    raw = make_raw(spark, [raw_row(price_avg_raw=10, turnover_qty_raw=-1), raw_row(price_avg_raw=20, turnover_qty_raw=2)])
    st, rep = L.load_batch(None, raw, files_df(spark, [(1, "f001.xlsx")]))
    assert [r.status for r in rep.collect()] == ["loaded"]
    assert st.facts.first().price_avg_weighted == Decimal("15")


def test_gate_rules_on_files_and_row_numbers(spark):
    files = files_df(spark, [(1, "a"), (2, "  ")])
    assert [(r.file_key, r.rule) for r in D.gate_files(files, "x").collect()] == [(2, "blank_file_name")]
    assert {(r.file_key, r.rule) for r in D.gate_files(files, " ").collect()} == {
        (1, "blank_source_type"), (2, "blank_source_type"), (2, "blank_file_name")
    }
    raw = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 2)], "file_key long, row_num int")
    assert {(r.file_key, r.rule, r.violations) for r in D.gate_row_numbers(raw).collect()} == {
        (1, "row_num_repeated", 1), (2, "row_num_not_positive", 1)
    }
    parts = N.daily_parts(make_raw(spark, [raw_row()]))
    assert [r.rule for r in D.gate_from_parts(parts, instrument_type="stamp").collect()] == ["instrument_type_unknown"]


def _root():
    return tempfile.mkdtemp(prefix="tl-state-")


def _one_file(spark, state, k, **kw):
    row = raw_row(file_key=k, file_name=f"f{k}.xlsx", **{"trade_datetime_raw": dt.datetime(2024, k, 9)} | kw)
    return L.load_batch(state, make_raw(spark, [row]), files_df(spark, [(k, f"f{k}.xlsx")]))[0]


def _files_below(root, table):
    return {p: os.path.getmtime(p) for d, _, names in os.walk(os.path.join(root, table)) for x in names if x.endswith(".parquet") for p in [os.path.join(d, x)]}


def test_publish_appends(spark):
    root = _root()
    assert L.read_state(spark, root) is None
    for k in (1, 2, 3):
        before = {t: _files_below(root, t) for t in ("raw_market_archive", "market_daily_stats")}
        number = L.publish(_one_file(spark, L.read_state(spark, root), k), root)
        assert number == k
        for t, files in before.items():  # nothing that was there is written again
            assert files.items() <= _files_below(root, t).items()
            assert len(_files_below(root, t)) == len(files) + 1
    back = L.read_state(spark, root)
    assert back.facts.count() == 3 and back.registry.count() == 3 and back.raw.count() == 3
    assert sorted(r.file_order for r in back.registry.collect()) == [1, 2, 3]


def test_facts_rebuilt_from_the_stored_raw_layer_are_the_same(spark):
    root = _root()
    for k in (3, 1, 2):  # the last load wins, whatever its name
        L.publish(_one_file(spark, L.read_state(spark, root), k, trade_datetime_raw=dt.datetime(2024, 1, 2), turnover_value_raw=k), root)
    back = L.read_state(spark, root)
    assert [r.turnover_value for r in back.facts.collect()] == [Decimal("2.00")]
    assert [r.turnover_value for r in N.build_daily_stats(back.raw).collect()] == [Decimal("2.00")]


def test_replaced_raw_rows_are_not_read_again(spark):
    root = _root()
    L.publish(_one_file(spark, None, 1), root)
    row = raw_row(file_key=1, file_name="f1.xlsx", trade_datetime_raw=dt.datetime(2024, 2, 9), turnover_value_raw=9)
    st, _ = L.load_batch(L.read_state(spark, root), make_raw(spark, [row]), files_df(spark, [(1, "f1.xlsx")]), replace=True)
    L.publish(st, root)
    back = L.read_state(spark, root)
    assert [r.turnover_value_raw for r in back.raw.collect()] == [Decimal("9.00")]
    assert {r.trade_date.month: r.file_key for r in back.facts.collect()} == {1: None, 2: 1}


def test_failed_publish_leaves_the_state_and_can_be_repeated(spark, monkeypatch):
    root = _root()
    L.publish(_one_file(spark, None, 1), root)
    with monkeypatch.context() as m:
        m.setattr(L, "write_pointer", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            L.publish(_one_file(spark, L.read_state(spark, root), 2), root)
    assert L.read_state(spark, root).facts.count() == 1 and L.read_state(spark, root).raw.count() == 1
    L.publish(_one_file(spark, L.read_state(spark, root), 2), root)
    assert L.read_state(spark, root).facts.count() == 2 and L.read_state(spark, root).raw.count() == 2


def test_stale_writer_is_refused(spark):
    root = _root()
    L.publish(_one_file(spark, None, 1), root)
    a, b = L.read_state(spark, root), L.read_state(spark, root)
    L.publish(_one_file(spark, a, 2), root)
    with pytest.raises(OSError):
        L.publish(_one_file(spark, b, 3), root)


def test_empty_state_can_be_read_back(spark):
    root = _root()
    st, _ = L.load_batch(None, make_raw(spark, []), files_df(spark, [(1, "empty.xlsx")]))
    L.publish(st, root)
    back = L.read_state(spark, root)
    assert back.raw.count() == 0 and back.facts.count() == 0
    assert [r.rows_count for r in back.registry.collect()] == [0]
    L.publish(_one_file(spark, back, 2), root)
    assert L.read_state(spark, root).facts.count() == 1


def test_materialize_twice_on_one_path(spark):
    raw = make_raw(spark, [raw_row(), raw_row(trade_datetime_raw=dt.datetime(2024, 1, 3))])
    path = _root()
    stored = Warehouse.from_raw(spark, raw).materialize(path)
    again = stored.materialize(path)
    assert stored.metrics.count() == again.metrics.count() == 2 and again.summary.count() == 1
    with pytest.raises(FileNotFoundError):
        Warehouse.from_path(spark, _root())


def test_manifest_with_empty_month_and_hashed_keys(spark):
    raw = make_raw(
        spark, [raw_row(file_key=-77, file_name="M_2024_01.xlsx", trade_datetime_raw=dt.datetime(2024, 1, d)) for d in (2, 2, 3)]
    )
    files = spark.createDataFrame(
        [(-77, "M_2024_01.xlsx"), (2**60, "M_2024_02.xlsx"), (5, "odd.xlsx")], "file_key long, file_name string"
    )
    m = {r.archive_file: (r.period_month, r.rows_count, r.trade_days_in_file) for r in L.archive_manifest(raw, files).collect()}
    assert m == {"M_2024_01.xlsx": ("2024-01", 3, 2), "M_2024_02.xlsx": ("2024-02", 0, 0), "odd.xlsx": (None, 0, 0)}
    folder = _root() + "/m"
    L.write_manifest(L.archive_manifest(raw, files), folder)
    assert spark.read.option("sep", ";").option("header", True).csv(folder).count() == 3


def test_reconciliation_with_overlap(spark):
    raw = make_raw(
        spark,
        [
            raw_row(file_key=1, file_name="f1.xlsx", turnover_value_raw=100),
            raw_row(file_key=2, file_name="f2.xlsx", turnover_value_raw=40),
        ],
    )
    st, _ = L.load_batch(None, raw, files_df(spark, [(1, "f1.xlsx"), (2, "f2.xlsx")]))
    rec = {r.file_key: r.difference for r in D.reconcile(st.registry, st.raw, st.facts).collect()}
    assert rec == {1: Decimal("100.00"), 2: Decimal("0.00")}


def test_distinct_pairs_count_null_fields(spark):
    facts = spark.createDataFrame([(1, None), (1, dt.date(2024, 1, 1))], "instrument_id long, trade_date date")
    r = D.distinct_pairs(facts).collect()[0]
    assert (r.market_daily_stats_rows, r.distinct_instrument_date_pairs) == (2, 2)


def test_quality_suite_on_clean_state(spark):
    raw = make_raw(spark, [raw_row(file_key=1, file_name="f1.xlsx"), raw_row(file_key=1, file_name="f1.xlsx", ticker_raw="BBB")])
    raw = with_row_number(raw, ["file_key"], ["ticker_raw"])
    st, _ = L.load_batch(None, raw, files_df(spark, [(1, "f1.xlsx")]))
    assert all(r.issue_count == 0 for r in D.value_checks(st).collect())
    assert all(r.issue_count == 0 for r in D.duplicate_checks(st).collect())
    assert all(r.issue_count == 0 for r in D.orphan_checks(st).collect())
    counts = {r.object_name: r.row_count for r in D.row_counts(st).collect()}
    assert counts["market_daily_stats"] == 2 and counts["import_files"] == 1


def test_orphan_rules_flag_missing_parents(spark):
    raw = make_raw(spark, [raw_row(file_key=1, file_name="f1.xlsx")])
    st, _ = L.load_batch(None, raw, files_df(spark, [(1, "f1.xlsx")]))
    broken = L.ArchiveState(st.registry.limit(0), st.raw, st.issuers, st.instruments, st.calendar.limit(0), st.facts)
    o = {r.check_name: r.issue_count for r in D.orphan_checks(broken).collect()}
    assert o["raw_without_import_file"] == 1 and o["stats_without_calendar_date"] == 1
    assert o["stats_with_invalid_file_id"] == 1 and o["stats_without_instrument"] == 0


def test_row_numbers_are_consecutive_per_group(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("o"))
    n = with_row_number(df, ["g"], ["o"], num_partitions=7)
    rows = n.collect()
    by_g: dict[int, list] = {}
    for r in rows:
        by_g.setdefault(r.g, []).append((r.o, r.row_num))
    for g, items in by_g.items():
        items.sort()
        assert [rn for _, rn in items] == list(range(1, len(items) + 1))


def numbers_table(spark, files):
    rows = [(k, n) for k, ns in files.items() for n in ns]
    return spark.createDataFrame(rows, "file_key long, row_num int")


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_row_numbers_are_proven_without_counting_them(spark, monkeypatch, block):
    monkeypatch.setattr(D, "SEQUENCE_BLOCK", block)
    good = {1: range(1, 20), 2: [3, 1, 2], 3: [1]}
    bad = {4: [1, 2, 2], 5: [2, 3], 6: [1, 1, 4, 4], 7: [1, None, 3], 8: [0, 1, 2], 9: [1, 1, 1, 4], 10: [1, 2, 3, 3, 5, 5, 7], 11: [-1, 3, 1]}
    raw = numbers_table(spark, good | bad)
    assert {r.file_key for r in D.unproven_files(raw).collect()} == set(bad)
    got = {(r.file_key, r.rule): r.violations for r in D.gate_row_numbers(raw).collect()}
    want = {}
    for k, ns in bad.items():
        if low := sum(n is not None and n <= 0 for n in set(ns)):
            want[k, "row_num_not_positive"] = low
        if again := sum(ns.count(n) > 1 for n in set(ns)):
            want[k, "row_num_repeated"] = again
    assert got == want


def test_proven_files_are_not_read_again(spark):
    raw = numbers_table(spark, {k: range(1, 50) for k in range(1, 6)})
    df = D.gate_row_numbers(raw)
    assert df.collect() == []
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "EmptyRelation" in final and "HashAggregate(keys=[file_key" not in final.split("EmptyRelation")[1]  # no number is counted


def test_file_lists_are_sent_to_rows_and_facts(spark):
    raw = make_raw(spark, [raw_row(file_key=k, file_name=f"f{k}.xlsx") for k in (1, 2)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state, _ = L.load_batch(None, raw, files_df(spark, [(1, "f1.xlsx"), (2, "f2.xlsx")]))
        gone = L.replace_files(state, spark.createDataFrame([("f1.xlsx",)], "file_name string"))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan(state.raw)
        assert any("BroadcastHashJoin" in line and "LeftAnti" in line for line in plan(gone.raw).split("\n") if "file_key" in line)
        assert any("BroadcastHashJoin" in line and "LeftOuter" in line for line in plan(gone.facts).split("\n") if "file_key" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orphans_are_counted_by_key(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    found = lambda parent, **o: D._orphans(child, spark.createDataFrame([(p,) for p in parent], "k int"), "k", "x", **o).first()["issue_count"]
    assert (found([2, 2]), found([1, 2], allow_null=True), found([])) == (3, 0, 4)
    plan = D._orphans(child, child, "k", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.rindex("Aggregate [k")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_rechecked_without_moving_rows(spark):
    raw = make_raw(spark, [raw_row(1), raw_row(1), raw_row(2)]).withColumn("row_num", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        semi = [line for line in plan_of(D._to_recheck(raw)).split("\n") if "LeftSemi" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert sorted(r.file_key for r in D._to_recheck(raw).collect()) == [1, 1]


def test_pairs_are_counted_on_partitions_sized_by_input(spark, monkeypatch):
    st, _ = L.load_batch(None, make_raw(spark, [raw_row(1)]), files_df(spark, [(1, "f1.xlsx")]))
    monkeypatch.setattr(D, "tasks_for", lambda df: 77)
    st.facts, st.raw = st.facts.unionByName(st.facts), st.raw.withColumn("row_num", F.lit(1))
    assert "77" in plan_of(D.duplicate_checks(st))
    assert {r.check_name: r.issue_count for r in D.duplicate_checks(st).collect()}["duplicate_market_daily_stats_pairs"] == 1


def test_finished_parts_give_the_facts_of_summed_ones(spark):
    rows = [raw_row(k, ticker_raw=t, price_avg_raw=10 + i, turnover_qty_raw=i, term_days_raw=None)
            for k in (1, 2) for t in ("AAA", " BBB ", None) for i in range(3)]
    parts = N.daily_parts(make_raw(spark, rows))
    want, got = N.facts_from_parts(parts).drop("created_at"), N.facts_from_parts(N.finished_parts(parts)).drop("created_at")
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_new_facts_stay_on_their_partitions(spark):
    files = files_df(spark, [(1, "f1.xlsx"), (2, "f2.xlsx")])
    st, _ = L.load_batch(None, make_raw(spark, [raw_row(1)]), files.where("file_key = 1"))
    stored = spark.createDataFrame(st.facts.collect(), st.facts.schema)
    parts = N.daily_parts(make_raw(spark, [raw_row(2)]), tasks=8)
    ranks = spark.createDataFrame([(2, "2/f2.xlsx")], "file_key long, file_rank string")
    facts = N.upsert_daily_stats(parts, ranks, stored, 8)
    assert plan_of(facts).count("Exchange hashpartitioning") == 2  # new rows once, stored facts once
    assert [r.file_key for r in facts.collect()] == [2]


def test_gate_passes_over_tuples_and_facts_once(spark):
    raw = make_raw(spark, [raw_row(1, currency_code_raw="USD"), raw_row(1, currency_code_raw="A LONG CURRENCY"), raw_row(2, price_min_raw=-1)])
    found = D.gate_from_parts(N.daily_parts(raw))
    assert plan_of(found).count("Scan ExistingRDD") == 4  # rows, days, tuples, facts
    got = {(r.file_key, r.rule, r.violations) for r in found.collect()}
    assert got == {(1, "instrument_conflict", 1), (1, "currency_code_too_long", 1), (2, "negative_price_min", 1)}
