from __future__ import annotations

import numpy as np
import pytest

from tradelake.llm import neighbours as N

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    """rows: (vec_id, vector) that take part."""
    out = {}
    for i, q in rows:
        if i % 50:
            continue
        scored = [(-float(q @ x / (np.sqrt(q @ q) * np.sqrt(x @ x))), j) for j, x in rows if j != i]
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def recall(got, want):
    hit = sum(len({j for j, _ in want[i]} & {j for j, _ in got.get(i, [])}) for i in want)
    return hit / max(1, sum(len(v) for v in want.values()))


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def check_scores(got, rows):
    by = dict(rows)
    for i, found in got.items():
        assert i not in [j for j, _ in found]
        for j, s in found:
            q, x = by[i], by[j]
            assert s == pytest.approx(q @ x / (np.linalg.norm(q) * np.linalg.norm(x)), abs=1e-12)
        assert [(-s, j) for j, s in found] == sorted((-s, j) for j, s in found)


def test_recall_on_the_test_table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in d.collect()]
    got = result(N.neighbour_digest(d))
    check_scores(got, rows)
    assert recall(got, brute(rows)) >= 0.9


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = [(i, centres[i % 30] + 0.3 * rng.normal(size=8)) for i in range(3000)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = result(N.nearest_neighbours(d, d.where("vec_id % 50 = 0"), sample=1500, leaf_rows=64))
    check_scores(got, rows)
    assert recall(got, brute(rows)) >= 0.9


def test_best_bin_first_order():
    x = np.random.default_rng(0).normal(size=(2000, 6))
    t = N.Tree(x, 50)
    for q in x[:20]:
        order = t.visit(q, t.leaves)
        assert sorted(order) == list(range(t.leaves))
        assert t.visit(q, 3) == order[:3]
    assert (np.bincount(t.assign(x), minlength=t.leaves) > 0).all()


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 120)] + [(200, [0.0, 1.0, 5.0]), (201, [-1.0, 0.0, 0.0])]
    bad = [
        (300, None), (350, []), (400, [0.0, 0.0, 0.0]), (450, [1.0, nan, 0.0]), (500, [1.0, inf, 0.0]), (550, [1.0, None, 0.0]),
        (600, [1.0, 2.0]), (None, same), (100, same),
    ]
    d = spark.createDataFrame(
        [(i, v, 1, "x", 0.5) for i, v in rows + bad], "vec_id long, embedding array<float>, leaf int, id string, score double"
    )
    got = result(N.neighbour_digest(d))
    want = brute([(i, np.array(v)) for i, v in rows])
    assert set(got) == {0, 50, 100, 200}
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    few = result(N.neighbour_digest(d.where("vec_id in (0, 200)")))
    assert {i: [j for j, _ in v] for i, v in few.items()} == {0: [200], 200: [0]}
    assert N.neighbour_digest(d.limit(0)).collect() == []
    assert N.neighbour_digest(d.where("vec_id = 50")).collect() == []


def test_repeated_rows_of_a_copy_group(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(12)] + [(50, same), (60, [0.0, 1.0, 5.0])]
    often = [r for r in rows for _ in range(7 if r[0] < 6 else 3)]
    d = spark.createDataFrame(often, "vec_id long, embedding array<float>")
    got = result(N.neighbour_digest(d))
    want = brute([(i, np.array(v)) for i, v in rows])
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [0, 1, 2, 3, 4]


def test_a_walk_is_one_row_and_small_leaves_share_units(spark, monkeypatch):
    """A query's vector is stored once, however many leaves it visits, and sent once to a bundle of leaves."""
    written, pinned = {}, N.pinned
    monkeypatch.setattr(N, "pinned", lambda df, name: written.setdefault(name, pinned(df, name)))
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8)) for i in range(3000)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = result(N.nearest_neighbours(d, d.where("vec_id % 50 = 0"), sample=3000, leaf_rows=32))
    check_scores(got, rows)
    assert recall(got, brute(rows)) >= 0.9
    walks = written["visits"].collect()
    assert len(walks) == 60
    assert max(sum(len(leaves) for leaves in w["leaves"]) for w in walks) > 10 and {len(w["bundles"]) for w in walks} == {1}


def test_bundles_and_tiles(monkeypatch):
    assert N.bundles_of({0: 3, 1: 4, 2: 9, 4: 2, 5: 6}, 6, 8) == [0, 0, 1, 2, 2, 2]
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(90, 5)), rng.normal(size=(70, 5))
    meet = rng.random((70, 90)) < 0.5
    whole = N.nearest_pairs(np.arange(70), q, np.arange(90), x, 3, lambda some: meet[some])
    monkeypatch.setattr(N, "TILE", 16)
    tiled = N.nearest_pairs(np.arange(70), q, np.arange(90), x, 3, lambda some: meet[some])
    assert all((a == b).all() for a, b in zip(whole, tiled)) and meet[whole[0], whole[1]].all() and len(whole[0]) == 210
