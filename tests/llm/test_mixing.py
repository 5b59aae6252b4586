from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tradelake.llm import mixing as M
from tradelake.llm.common import WORD


def size(t):
    return len(re.findall(WORD, t or ""))


def brute_targets(sizes, weights, share, cap):
    """Water level by bisection, instead of rounds of resharing."""
    total, lo, hi = share * sum(sizes), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(cap * s, w * lo) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(5))
def test_targets_against_water_level(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 1000, 9).tolist()
    w = [[5, 2, 1][i % 3] for i in range(9)]
    assert M.targets(sizes, w, 1.5, 2.0) == pytest.approx(brute_targets(sizes, w, 1.5, 2.0), abs=1e-6)


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 7, 64, 1000):
        p = M.Permutation(n, 1, 2, 3)
        out = p(np.arange(n))
        assert sorted(out) == list(range(n))
        assert (p(out, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_slots_take_exactly_the_target(block):
    for words in (1, 5, 100, 1023, 1024, 1025, 5000):
        for target in (0, 1, words // 2, words, words + 1, 2 * words - 1, 2 * words):
            p = M.plan_source(0, "s", words, float(target), block, 3)
            taken, used = 0, Counter()
            for j in range(p.slots):
                e, k = divmod(j, p.blocks)
                b = int(M.Permutation(p.blocks, 3, 0, e)(k)[0])
                own = min(block, words - b * block)
                taken += min(own, p.last_words) if j == p.slots - 1 else own
                used[b] += 1
            assert taken == target and max(used.values(), default=0) <= 2


def check(rows, docs):
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append(size(r["text"]))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    goal = brute_targets([sum(by[s]) for s in order], [[5, 2, 1][i % 3] for i in range(len(order))], 1.5, 2.0)
    goal = dict(zip(order, goal))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter(
        (r["doc_id"], size(r["text"]), r["source"]) for r in docs
    )
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sum(by[r["source"]])
        assert r["target"] == pytest.approx(goal[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 1


def test_digest(spark, docs, edge, none):
    first = M.mix_digest(docs).collect()
    check(first, docs.collect())
    assert sorted(map(tuple, first)) == sorted(map(tuple, M.mix_digest(docs.repartition(5)).collect()))
    check(M.mix_digest(edge).collect(), edge.collect())
    assert M.mix_digest(none).count() == 0


def test_every_slot_once_over_many_shards(spark, docs):
    m = M.mix(docs, block_words=16, shard_slots=50)
    rows = m.slots.collect()
    assert Counter((r["sidx"], r["slot"]) for r in rows) == Counter((p.index, j) for p in m.sources for j in range(p.slots))
    assert max(Counter(r["shard"] for r in rows).values()) <= 50 * len(m.sources)


@pytest.mark.parametrize("block", [8, 1024])
def test_mixed_texts_hold_the_words_taken(spark, docs, edge, block):
    for d in (docs, edge):
        out = M.mixed_documents(d, block_words=block)
        assert out.dtypes == d.dtypes
        rows, src = out.collect(), d.collect()
        texts = {}
        for r in src:
            texts.setdefault((r["doc_id"], r["source"]), []).append(r["text"])
        words = Counter()
        for r in rows:
            assert any(r["text"] in (t or "") for t in texts[(r["doc_id"], r["source"])])
            assert r["n_chars"] == len(r["text"])
            words[r["source"]] += size(r["text"])
        goal = {s.name: s.target for s in M.mix(d).sources}
        assert all(abs(words[s] - goal[s]) <= 1 for s in goal)


def test_no_rows_to_mix(none):
    assert M.mixed_documents(none).collect() == []


def test_columns_of_any_names_pass(spark, docs):
    names = ("_size", "_uses", "_sidx", "_start", "_row", "_source", "_order", "size", "words", "c0", "c1")
    own = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    got, want = M.mixed_documents(own), M.mixed_documents(docs)
    assert got.columns == own.columns
    assert sorted(map(tuple, got.select(*docs.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
