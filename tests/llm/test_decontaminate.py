from __future__ import annotations

import random

import numpy as np
import pytest

from tradelake.llm import decontaminate as D


def brute(pattern, text):
    """Least edits of the whole pattern against any part of the text (plain dynamic programme)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def noisy(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        k = rng.randrange(3)
        if k == 0:
            s[i] = rng.choice("abcdefgh")
        elif k == 1:
            s.insert(i, rng.choice("abcdefgh"))
        else:
            del s[i]
    return "".join(s)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_no_region_within_the_budget_is_lost(seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randrange(8, 60))) for k in range(12)]
    w = D.Windows(items, 100, 0.1, 32)
    texts = []
    for k in range(30):
        body = words(rng, rng.randrange(0, 60))
        if k % 2:
            _, t = items[rng.randrange(len(items))]
            at = rng.randrange(max(1, len(t) - 110))
            body += " " + noisy(rng, t[at : at + rng.randrange(60, 140)], rng.randrange(0, 14)) + " " + words(rng, 20)
        texts.append(body)
    got = {(t, item): e for t, item, e, *_ in D.find(texts, w)}
    want = {}
    for n, t in enumerate(texts):
        for i, p in enumerate(w.text):
            e = brute("".join(map(chr, p)), D.normal(t))
            if e <= w.edits[i]:
                key = (n, w.item[i])
                want[key] = min(want.get(key, 99), e)
    assert want  # the case exercises something
    assert set(got) == set(want)
    assert all(want[k] <= e for k, e in got.items())


def test_long_texts_are_searched_whole(monkeypatch):
    rng = random.Random(1)
    item = words(rng, 30)
    monkeypatch.setattr(D, "SEGMENT", 700)
    w = D.Windows([(1, item)], 100, 0.1, 32)
    for at in range(0, 600, 37):
        text = words(rng, at) + " " + item + " " + words(rng, 200)
        found = list(D.find([text], w))
        assert len(found) == 1 and found[0][2] == 0
        end = found[0][3]
        assert D.normal(text)[end - 40 : end] in D.normal(item)


def test_gram_hash_differs_by_position():
    a, b = D.gram_hashes(D.codes("abcdefgh")), D.gram_hashes(D.codes("bacdefgh"))
    assert len(a) == 1 and a[0] != b[0]


def test_matches_and_filter(spark, edge, none):
    leak = "The quick brown fox jumps over the lazy dog and runs far away home"
    schema = edge.schema
    extra = spark.createDataFrame(
        [
            (100, f"some words before {leak.upper()}  and after", "en", "a", 0, 1, "s", 2, "k"),
            (None, f"x {leak.replace('lazy', 'lzy')}", "en", "a", 0, 1, "s", 2, "k"),
            (101, leak[:30], "en", "a", 0, 1, "s", 2, "k"),
            (102, leak, "en", "a", 0, 1, "s", 2, "k"),
            (102, leak, "en", "a", 0, 1, "s", 2, "k"),
        ],
        schema,
    )
    bench = spark.createDataFrame([(1, leak), (2, None), (3, ""), (4, "tiny"), (1, leak)], "item_id long, text string")
    d = edge.unionByName(extra)
    got = D.matches(d, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["edits"]) for r in got) == [(-1, 1, 1), (100, 1, 0), (102, 1, 0), (102, 1, 0)]
    many = D.matches(d, bench, block_chars=70).select("doc_id", "item_id", "edits").distinct().collect()
    assert {(r["doc_id"], r["item_id"]) for r in many} == {(None, 1), (100, 1), (102, 1)}
    kept = D.decontaminated(d, bench)
    assert kept.schema == d.schema
    assert kept.count() == d.count() - 4
    assert D.matches(none, bench).count() == 0
    assert D.matches(d, bench.limit(0)).count() == 0
    assert D.decontaminated(d, bench.limit(0)).count() == d.count()


def test_planted_items_of_the_test_tables(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()}
    texts = [(r["doc_id"], D.normal(r["text"])) for r in docs.collect()]
    exact = {(i, b["item_id"]) for b in bench.collect() for i, t in texts if D.normal(b["text"]) in t}
    assert exact <= got
    w = D.Windows([(b["item_id"], b["text"]) for b in bench.collect()], 100, 0.1, 32)
    by = dict(texts)
    for i, item in got - exact:  # whatever else is reported holds a verified region
        assert any(brute("".join(map(chr, p)), by[i]) <= w.edits[k] for k, p in enumerate(w.text) if w.item[k] == item)
    assert np.isin([i for i, _ in got], [i for i, _ in texts]).all()
