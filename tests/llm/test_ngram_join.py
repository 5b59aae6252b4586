from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelake.llm import ngram_join as J
from tradelake.llm.components import connected_components


def plain_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def linked(a, b, threshold=85):
    return bool(a and b) and 100 * len(a & b) >= threshold * len(a | b)


def brute(rows):
    sets = [plain_set(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_copies(seed, base_words, copies, edits):
    """Copies of one text with a few words changed; copies need not be near each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        t = list(base)
        for k in range(rng.randint(0, edits)):
            t[rng.randrange(base_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(7, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**31), st.sampled_from([60, 85, 95]))
def test_sets_that_link_share_a_signature(size, dropped, added, seed, threshold):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.r_[rng.permutation(a)[min(dropped, size - 1) :], rng.integers(0, 2**64, added, dtype=np.uint64)])
    both = len(np.intersect1d(a, b))
    if 100 * both >= threshold * (len(a) + len(b) - both) and both < max(len(a), len(b)):
        assert set(J.signatures(a, threshold).tolist()) & set(J.signatures(b, threshold).tolist())


@pytest.mark.parametrize("threshold", [51, 85, 99])
def test_bands(threshold):
    ends = J.band_ends(threshold, 10_000)
    for size in range(1, 4000):
        largest = size * 100 // threshold  # of a set that can link with one of this size
        own, other = np.searchsorted(ends, size), np.searchsorted(ends, largest)
        assert other - own <= 1
        assert (size + largest) * (100 - threshold) // (100 + threshold) <= J.band_difference(ends[other], threshold)


def test_pieces_of_a_long_text_give_the_same_hashes(monkeypatch):
    text = ("Alpha  beta\tgamma\x0b\n" * 40 + "é\x85z ").encode()
    want = J.shingle_set(text).tolist()
    for piece in (1, 5, 17):
        monkeypatch.setattr(J, "PIECE", piece)
        assert J.shingle_set(text).tolist() == want


def test_edge_rows(spark, edge, none):
    rows = edge.withColumns({c: F.lit("x") for c in ("node", "key", "t1", "sig", "first", "least", "_id", "root")})
    assert result(J.ngram_digest(rows)) == brute(edge.collect())
    assert J.ngram_digest(none).collect() == []


def test_documents_and_planted_copies(spark, docs):
    texts = [t for s, w in enumerate((9, 30, 60, 150)) for t in near_copies(s, w, 25, max(1, w // 25))]
    own = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(own).repartition(5)
    assert result(J.ngram_digest(some)) == brute(some.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 14), st.integers(0, 2**31), st.booleans(), st.booleans())
def test_few_nodes_and_many_give_the_same(size, seed, every, across):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 520, dtype=np.uint64)
    rows = []
    for k in range(size):
        h = np.unique(np.r_[base[: rng.integers(480, 521)], rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64)])
        rows.append((bool(across and k % 2), b"%02d" % k, len(h), J.sketch(h).tobytes(), b"%d" % rng.integers(4)))
    side, node, n, sketches, root = zip(*rows)
    number = {r: k for k, r in enumerate(dict.fromkeys(root))}
    apart = np.array([number[r] for r in root])
    d = J.distances(list(sketches), np.array(n), apart, 85)
    if across:
        d[np.array(side)[:, None] == np.array(side)[None, :]] = J.FAR
    got = J.few_pairs(rows, 85, every)
    if every:
        assert sorted(got) == sorted((node[i], node[j]) for i, j in zip(*np.nonzero(np.triu(d < J.FAR))))
        return

    def components(pairs):
        label = dict(zip(node, root))
        for a, b in pairs:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        return sorted(label.values())

    assert len({*got}) == len(got) < size
    u, v = J.nearest_forest(d, apart)
    same = lambda pairs: [[components(pairs).count(x)] for x in components(pairs)]
    assert same(got) == same([(node[i], node[j]) for i, j in zip(u, v)])
    assert all(d[node.index(a), node.index(b)] < J.FAR for a, b in got)


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("tile", [3, 20, 1024])
def test_large_groups_lose_no_link(spark, tile, few, monkeypatch):
    """Copies around a base; most link only through it or through a few others."""
    monkeypatch.setattr(J, "FEW", few)
    texts = near_copies(7, 120, 70, 4)
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(J.ngram_groups(some, tile=tile).drop("node")) == brute(some.collect())


def test_tiles_meet_once_each(spark):
    rows = [(7, b"%04d" % k) for k in range(300)] + [(8, b"x")]
    dealt = J.units(spark.createDataFrame(rows, "sig long, node binary"), tile=40).collect()
    unit = {}
    for r in dealt:
        unit.setdefault((r.sig, r.i, r.j), []).append((bytes(r.node), r.side))
    met = set()
    for (sig, i, j), own in unit.items():
        for a, sa in own:
            for b, sb in own:
                if a < b and (i == j or sa != sb):
                    assert (a, b) not in met
                    met.add((a, b))
    assert len(met) == 300 * 299 // 2 and max(map(len, unit.values())) < 160


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 600), st.integers(0, 600), st.integers(0, 2**31))
def test_sketches_never_differ_more_than_the_sets(size, dropped, added, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.r_[a[min(dropped, len(a) - 1) :], rng.integers(0, 2**64, added, dtype=np.uint64)])
    x, y = J.sketch(a), J.sketch(b)
    words = min(len(x), len(y))
    assert np.bitwise_count(J.folded(x, words) ^ J.folded(y, words)).sum() <= len(np.setxor1d(a, b))


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 40), st.integers(0, 2**31))
def test_forest_spans_what_is_near(size, seed):
    rng = np.random.default_rng(seed)
    d = np.where(rng.random((size, size)) < 1.5 / size, rng.integers(0, 9, (size, size)), J.FAR).astype(np.int32)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, J.FAR)

    def components(u, v):
        root = list(range(size))
        for x, y in zip(u, v):
            old, new = root[x], root[y]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(size) if root[i] == r) for r in root}

    u, v = J.nearest_forest(d)
    assert all(d[x, y] < J.FAR for x, y in zip(u, v)) and len(u) < 2 * size
    assert components(u, v) == components(*np.nonzero(d < J.FAR))


def test_components_of_binary_nodes(spark):
    edges = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"y", b"x")], "u binary, v binary")
    got = {(bytes(r["node"]), bytes(r["root"])) for r in connected_components(edges).collect()}
    assert got == {(b"b", b"a"), (b"c", b"a"), (b"y", b"x")}


def test_stars_sort_by_the_signature_alone(spark):
    """Each signature's nodes meet beside one of them, repeated rows too, without a sort by node."""
    rng = random.Random(5)
    rows = [(s, k) for s in range(400) for k in rng.sample(range(50), 1 + s % 4)]
    rows += rng.sample(rows, 200) + [(-7, k % 3000) for k in range(25_000)]  # more than an Arrow batch
    rng.shuffle(rows)
    df = J.stars(spark.createDataFrame(rows, "sig long, key long"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [sig" in plan and ", key" not in plan.split("Sort [sig")[1].split("]")[0]
    got = [tuple(r) for r in df.collect()]
    want: dict[int, set[int]] = {}
    for s, k in rows:
        want.setdefault(s, set()).add(k)
    found: dict[int, set[int]] = {}
    for s, first, key in got:
        assert key != first
        found.setdefault(s, {first}).add(key)
    assert found == {s: keys for s, keys in want.items() if len(keys) > 1}
    assert all(len({f for s, f, _ in got if s == x}) == 1 for x in (-7, 3, 7))
    small = [r for r in got if r[0] >= 0]
    assert len(small) == len(set(small)) and all(first == min(want[s]) for s, first, _ in small if s % 4 == 1)
