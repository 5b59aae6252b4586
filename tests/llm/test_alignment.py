from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradelake.llm import alignment as A

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PLAIN_A = Tokenizer.from_file(BYTE)
PLAIN_A.encode_special_tokens = True
PLAIN_B = sentencepiece.SentencePieceProcessor(model_file=PIECE)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t.'sab▁<>0x41|　\x85\x1c"))


def plain(text):
    """Groups and links of a whole text, straight from the definition."""
    if not text:
        return [], []
    data = (" " + text).encode()
    a, b = PLAIN_A.encode(" " + text, add_special_tokens=False).ids, PLAIN_B.encode(text)
    bytes_a, bytes_b = A._byte_tokenizer(BYTE)[1], A._piece_tokenizer(PIECE)[1]
    if b"".join(bytes_a[i] for i in a) != data or b"".join(bytes_b[i] for i in b) != data:
        return [], []
    ends = [np.cumsum([len(e[i]) for i in ids]).tolist() for e, ids in ((bytes_a, a), (bytes_b, b))]
    last_b = dict(zip(ends[1], b))
    cuts = sorted(set(ends[0]) & set(ends[1]))
    own = [([], []) for _ in cuts]
    for side, (ids, end) in enumerate(zip((a, b), ends)):
        for i, e in zip(ids, end):
            own[bisect_left(cuts, e)][side].append(i)
    groups = ["|".join(",".join(map(str, x)) for x in g) for g in own]
    links = [(i, last_b[e]) for i, e in zip(a, ends[0]) if e in last_b]
    return groups, links


def brute(rows):
    each = [(r["doc_id"], *plain(r["text"])) for r in rows]
    count = Counter(x for _, _, links in each for x in links)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for i, groups, links in each:
        n_a = sum(len(g.split("|")[0].split(",")) for g in groups)
        n_b = sum(len(g.split("|")[1].split(",")) for g in groups)
        best = sum(count[x] == most[x[1]] for x in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(count[x] for x in links), sha))
    return Counter(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET), max_size=4), st.sampled_from([1, 3, 8, 1 << 20]))
def test_words_and_pieces_equal_the_whole_text(texts, piece):
    aligner, whole = A.Aligner(BYTE, PIECE, memory=2000), A.PIECE
    A.PIECE = piece
    try:
        for t in texts:
            n_a, n_b, n_groups, n_links, sha, linked = aligner.text(t)
            groups, links = plain(t)
            assert (n_groups, n_links) == (len(groups), len(links))
            assert sha == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            assert linked.tolist() == [i * aligner.stride + j for i, j in links]
    finally:
        A.PIECE = whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 299)), unique=True), st.sampled_from([300, 64_000]))
def test_bitmaps_round_trip(members, n_docs):
    members = sorted(members)
    group = np.array([g for g, _ in members], dtype=np.int64)
    position = np.array([p for _, p in members], dtype=np.int64)
    names, bitmaps = A.containers(group, position, n_docs)
    at, found = A.positions(bitmaps)
    assert sorted(zip(names[at].tolist(), found.tolist())) == members
    if len(bitmaps) > 1:
        at, found = A.positions(bitmaps.slice(1))
        assert sorted(zip(names[1:][at].tolist(), found.tolist())) == [m for m in members if m[0] != names[0]]


def test_index_counts_documents_and_links(spark):
    rows = [(i, [1, 2, 7] if i % 2 else [2], [1 + i % 5, 3, 1 << 20] if i % 2 else [i + 1]) for i in range(400)]
    schema = "doc_id long, pairs array<long>, times array<int>"
    for docs, postings in ((1 << 16, 10**6), (7, 10**6), (1 << 16, 5)):
        index = A.pair_index(spark.createDataFrame(rows, schema).repartition(3), docs, postings)
        counts = {r["pair"]: (r["docs"], r["links"]) for r in A.pair_counts(index, 5).collect()}
        want = defaultdict(lambda: [0, 0])
        for _, pairs, times in rows:
            for p, n in zip(pairs, times):
                want[p] = [want[p][0] + 1, want[p][1] + n]
        assert counts == {p: tuple(v) for p, v in want.items()}
        best = {r["pair"] for r in A.pair_counts(index, 5).where("best").collect()}
        assert best == {1, max((2, 7), key=lambda p: want[p][1])}


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_documents_against_brute_force(spark, edge, docs, size, monkeypatch):
    extra = spark.createDataFrame(
        [(70, "a"), (70, "a"), (71, "<|endoftext|> </s> <0x41>"), (72, "two  spaces "), (73, "▁"), (74, " x"), (75, "tab\t x\n y")],
        "doc_id long, text string",
    )
    some = docs.select("doc_id", "text").union(edge.select("doc_id", "text")).union(extra)
    some = some.withColumns({c: F.lit(7) for c in ("pair", "chunk", "pairs", "members", "count", "n_a")})
    index = A.pair_index(A.encoded(some, BYTE, PIECE, "doc_id", "text"), chunk_docs=size)
    got = A.scored(index, A.pair_counts(index, 32_000)).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(some.collect())


def test_pairs_and_empty_table(spark, none, edge):
    assert A.alignment_digest(none, BYTE, PIECE).collect() == []
    documents, pairs = A.alignment(edge, BYTE, PIECE)
    links = Counter(x for r in edge.collect() for x in plain(r["text"])[1])
    assert {(r["a_id"], r["b_id"]): r["links"] for r in pairs.collect()} == links
    assert documents.count() == edge.count()
