"""The registered queries of the subpackage, and the ones with SQL against DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tradelake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in Q.QUERIES
    assert set(Q.QUERIES) <= set(E.queries()) and set(Q.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs_over_the_whole_table(spark, name):
    rows = Q.QUERIES[name](spark, SF).collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    per_document = {"op1_mixing", "op2_token_files", "op4_simhash", "op5_token_counts", "op9_quality", "op10_language", "op11_alignment"}
    assert len(rows) == documents if name in per_document else rows
