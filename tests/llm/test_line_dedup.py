from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from tradelake.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows, near_chars=20):
    lines = []
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r\n\x0b\x0c"):
                lines.append(((doc_id is None, doc_id or 0, k), doc_id, k, line))
    lines.sort(key=lambda x: x[0])
    first = {}
    for at, _, _, line in lines:
        first.setdefault(line, at)
    long = sorted((x for x in first if len(x) >= near_chars), key=first.get)
    near = {a for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1}
    out = {}
    for at, doc_id, k, line in lines:
        if first[line] != at or line in near:
            out.setdefault(doc_id, []).append(k)
    return out


def varied(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abé") + line[i:], line[:i] + "z" + line[i + 1 :], line])


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cé") for _ in range(n)) + "x" for n in (5, 18, 19, 20, 21, 40, 63, 64, 65, 130, 131, 400)]
    rows = []
    for doc_id in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.randrange(0, 3)):
                line = varied(rng, line) or "y"
            lines.append(rng.choice(["", "  ", "\t"]) + line + rng.choice(["", "\r"]))
            if rng.random() < 0.2:
                lines.append("  ")
        rows.append((doc_id, "\n".join(lines)))
    rows += [(None, base[5]), (1000, None), (1001, ""), (1002, "\n\n"), (1003, base[-1] + "\n" + base[-1][:-1])]
    want = brute(rows)
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, line string, pos int, h1 long")
    got = L.line_digest(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["dropped"] == ",".join(map(str, want.get(r["doc_id"], []))), r
        assert r["n_dropped"] == len(want.get(r["doc_id"], []))
    clean = {r["doc_id"]: r["text"] for r in L.deduplicated_lines(d).collect()}
    for i, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, []))
        assert clean[i] == kept


def test_edges(spark, edge, none):
    out = L.line_digest(edge).collect()
    assert len(out) == edge.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_lines"] for r in by[2] + by[3] + by[4]] == [0, 0, 0]
    assert [r["n_dropped"] for r in by[8]] == [0, 0]  # equal rows are one document
    assert by[6][0]["n_dropped"] == 1 and by[5][0]["n_dropped"] == 0  # a very long line, repeated
    assert by[None][0]["dropped"] == "1"
    assert L.line_digest(none).collect() == []


def test_no_python_in_the_plan(docs):
    plan = L.line_digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_of_any_names_pass(spark, docs):
    own = docs.withColumns({c: F.lit(i) for i, c in enumerate(("_key", "_id", "_dropped", "_row", "_all", "row_key", "line"))})
    got = L.deduplicated_lines(own)
    assert got.columns == own.columns
    want = L.deduplicated_lines(docs).collect()
    assert sorted(map(tuple, got.select(*docs.columns).collect()), key=str) == sorted(map(tuple, want), key=str)
