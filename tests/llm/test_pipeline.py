from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tradelake.llm import decontaminate as D
from tradelake.llm import mixing, quality
from tradelake.llm.common import pinned

from .test_mixing import size
from .test_simhash import brute_groups, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in C.STAGES:
        out.append(pinned(f(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_columns(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality_stage(spark, steps):
    net = quality.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(steps[0], net).collect()}
    assert ids(steps[1]) == Counter(i for i, p in scores.items() if p)


def test_near_duplicate_stage(steps):
    rows = steps[1].collect()
    groups = brute_groups([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows], 2)
    assert ids(steps[2]) == Counter(set(groups))


def test_decontamination_stage(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    w = D.Windows(items, 100, 0.1, 32)
    rows = steps[2].collect()
    bad = {rows[t]["doc_id"] for t, *_ in D.find([r["text"] for r in rows], w)}
    exact = {r["doc_id"] for r in rows if any(D.normal(t) in D.normal(r["text"]) for _, t in items)}
    assert exact <= bad
    assert ids(steps[3]) == Counter(r["doc_id"] for r in rows if r["doc_id"] not in bad)


def test_mixing_stage(steps):
    rows, texts = steps[4].collect(), {r["doc_id"]: r["text"] for r in steps[3].collect()}
    sizes, taken = Counter(), Counter()
    for r in steps[3].collect():
        sizes[r["source"]] += size(r["text"])
    for r in rows:
        assert r["text"] in texts[r["doc_id"]]
        taken[r["source"]] += size(r["text"])
    order = sorted(sizes)
    goal = mixing.targets([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))], 1.5, 2.0)
    assert all(abs(taken[s] - g) <= 1 for s, g in zip(order, goal))


def test_token_stage_and_run(spark, steps):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[4].collect():
        code = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        want[(r["doc_id"], len(code), zlib.crc32(code.tobytes()))] += 1
    digest = lambda df: Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    assert digest(steps[5]) == want
    assert digest(C.run(spark, SF)) == want


def test_empty_and_odd_documents(spark, edge, none):
    for d in (edge, none):
        d = d.select("doc_id", "text", "lang", "source", "n_chars")
        for name, f in C.STAGES:
            d = pinned(f(spark, d, SF), f"edge-{name}")
        d.collect()
