from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tradelake.llm import simhash as S
from tradelake.llm.common import WORD
from tradelake.llm.components import connected_components

SIGN = 1 << 63


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(ids, fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(fps)
    for own in groups.values():
        known = [ids[i] for i in own if ids[i] is not None]
        for i in own:
            out[i] = min(known) if known else None
    return out


def test_digest(spark, docs, edge, none):
    for d in (docs, edge):
        rows = d.collect()
        fps = [plain_fingerprint(r["text"]) for r in rows]
        comp = brute_groups([r["doc_id"] for r in rows], fps, 2)
        want = sorted((r["doc_id"] or -99, f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))
        got = sorted((r["doc_id"] or -99, r["fingerprint"], r["component_id"]) for r in S.simhash_digest(d).collect())
        assert got == want
    assert S.simhash_digest(none).collect() == []


@pytest.mark.parametrize("tile", [4, 16, 2048])
def test_links_lose_nothing_in_hot_groups(spark, tile):
    rng = random.Random(tile)
    fps = set()
    for _ in range(12):  # crowded balls of near fingerprints and chains between them
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3)))
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >= SIGN else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = S.links(table, 2, tile)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_groups(signed, [f & ((1 << 64) - 1) for f in signed], 2)
    assert got == want
    assert all(((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() >= 1 for r in edges.collect())


def test_tile_links_skips_only_what_cannot_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(0, 40, 3)]))
    u, v = S.tile_links(x, None, 2)
    comp = {int(a): int(b) for a, b in zip(u, v)}
    want = brute_groups([int(a) for a in x], [int(a) for a in x], 2)
    got = {}
    for a, w in zip(x, want):
        got.setdefault(comp.get(int(a), int(a)), set()).add(w)
    assert all(len(s) == 1 for s in got.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 4), (5, 4)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark, docs, edge, none):
    for d in (docs, edge):
        rows = d.collect()
        fps = [plain_fingerprint(r["text"]) for r in rows]
        groups = brute_groups(list(range(len(rows))), fps, 2)
        kept = S.drop_near_duplicates(d)
        assert kept.columns == d.columns
        kept = kept.collect()
        assert len(kept) == len(set(groups))
        smallest = {}
        for r, g in zip(rows, groups):
            key = (r["doc_id"] is None, r["doc_id"] or 0)
            smallest[g] = min(smallest.get(g, key), key)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(smallest.values())
    assert S.drop_near_duplicates(none).collect() == []


@pytest.mark.parametrize("size", [1, 9, 40, 1 << 20])
def test_pieces_of_a_long_text_give_the_same_hashes(size):
    for text in ("One two  Three\tfour\nfive six " * 20, "a b", "a", "", None, "  x\x0by  ", "a b c", "a b c d"):
        parts = list(S.hash_pieces(text, 3, 42, size))
        assert S.fingerprint(parts) == S.fingerprint(S.hash_pieces(text, 3, 42))
        assert S.fingerprint(parts) & (2**64 - 1) == plain_fingerprint(text) & (2**64 - 1)


def test_columns_of_any_names_pass(spark, docs):
    own = docs.withColumns({c: F.lit(i) for i, c in enumerate(("_row", "_row_hash", "_kept_id", "_id", "_all", "fp", "root", "k"))})
    got = S.drop_near_duplicates(own)
    assert got.columns == own.columns and got.count() == S.drop_near_duplicates(docs).count()
