from __future__ import annotations

import re
import zlib
from math import log2

import numpy as np
import pandas as pd

from tradelake.llm import lang_id as L
from tradelake.llm import quality as Q
from tradelake.llm.common import held_out

SF1 = "/root/testdata/sf0.01"


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_rule(spark):
    d = spark.range(-50, 200)
    got = {r["id"]: r["h"] for r in d.select("id", held_out(d["id"]).alias("h")).collect()}
    assert got == {i: out_of_training(i) for i in range(-50, 200)}


# --- quality


def test_passages_cover_the_whole_text():
    texts = ["a b c", None, "", " \n ", " ".join(f"w{i}" for i in range(1001)), "x" * 3_000_000, "é ü 你"]
    x, n = Q.encode(texts)
    assert n.tolist() == [1, 1, 1, 1, 11, 1, 1]
    assert len(x) == n.sum() and np.isfinite(x).all()
    for t, own in zip(texts, np.split(x, np.cumsum(n)[:-1])):
        alone, k = Q.encode([t])
        assert k[0] == len(own) and np.allclose(alone, own)
    junk, _ = Q.encode([" ".join(f"w{i}" for i in range(1000)) + " zz" * 30])
    plain, _ = Q.encode([" ".join(f"w{i}" for i in range(1030))])
    assert not np.allclose(junk[-1], plain[-1]) and np.allclose(junk[0], plain[0])


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(9, 5)), np.array([2, 1, 4, 2])
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    net = Q.Network({k: rng.normal(size=s) for k, s in shapes.items()})

    def loss():
        p = net.forward(x, n)[0]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grad = net.gradients(x, n, y, w)
    for k, v in net.p.items():
        for i in np.ndindex(v.shape):
            old = v[i]
            v[i] = old + 1e-6
            up = loss()
            v[i] = old - 1e-6
            down = loss()
            v[i] = old
            assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-6


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    net = Q.train(docs, labels)
    rows = {r["doc_id"]: r for r in Q.quality_scores(docs, net).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == out_of_training(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels.collect() if out_of_training(r["doc_id"])]
    assert np.mean([a == b for a, b in held]) >= 0.95
    kept = {r["doc_id"] for r in Q.keep_quality(docs, net).collect()}
    assert kept == {i for i, r in rows.items() if r["predicted"]}
    again = Q.train(docs.repartition(3), labels.repartition(4))
    assert all((net.p[k] == again.p[k]).all() for k in net.p)


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs.withColumn("lang", F.lit("zz")), flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    net = Q.train(edge, labels)
    out = Q.quality_scores(edge, net).collect()
    assert len(out) == edge.count()
    empty = {r["score"] for r in out if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] for r in out if r["doc_id"] is None)
    assert Q.quality_scores(none, net).collect() == []
    one = Q.train(edge, labels.where("quality = 1"))
    assert {r["score"] for r in Q.quality_scores(edge, one).collect()} == {1.0}
    assert {r["score"] for r in Q.quality_scores(edge, Q.train(edge, labels.limit(0))).collect()} == {0.5}
    kept = Q.keep_quality(edge, one)
    assert kept.schema == edge.schema and kept.count() == edge.count()


# --- language


def plain_bits(training: list[bytes], text: bytes) -> float:
    """Code length by the definition, from dictionaries."""
    counts = {}
    for t in training:
        t = bytes(L.ORDER) + t
        for i in range(L.ORDER, len(t)):
            for k in range(L.ORDER + 1):
                own = counts.setdefault(t[i - k : i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    total, t = 0.0, bytes(L.ORDER) + text
    for i in range(L.ORDER, len(t)):
        for k in range(L.ORDER, -1, -1):
            own = counts.get(t[i - k : i])
            if not own:
                continue
            n, d = sum(own.values()), len(own)
            if t[i] in own:
                total += -log2(own[t[i]] / (n + d))
                break
            total += -log2(d / (n + d))
        else:
            total += 8
    return total


def model_of(training: dict[str, list[bytes]]) -> L.ByteModel:
    frames = []
    for lang, texts in training.items():
        code, n = np.unique(np.concatenate([L.context_codes(t) for t in texts]), return_counts=True)
        frames.append(pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n}))
    return L.ByteModel(pd.concat(frames))


def test_code_lengths_against_the_definition(monkeypatch):
    training = {"a": [b"abracadabra abracadabra", b"the cat"], "b": ["été à la plage".encode(), b"abra"], "c": [b"\x00\x00x"]}
    m = model_of(training)
    texts = [b"", b"a", b"abracadabra", "été".encode(), b"zzzzqq\xff", b"the abra cat the cat", b"\x00\x00\x00\x00\x00"]
    for chunk in (4_000_000, 3):
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = m.code_lengths(texts)
        for i, t in enumerate(texts):
            for j, lang in enumerate(m.langs):
                assert abs(got[i, j] - plain_bits(training[lang], t)) < 1e-3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    rows = {r["doc_id"]: r for r in L.predict(docs, L.train(docs, sample_bytes=400_000)).collect()}
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    held = [rows[i]["lang_pred"] == g for i, (g, _) in truth.items() if out_of_training(i) and g]
    assert np.mean(held) >= 0.95
    assert all(r["held_out"] == out_of_training(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    for i, (_, t) in truth.items():
        assert (rows[i]["lang_pred"] == "und") == (not t or not re.search(r"[^\W\d_]", t))


def test_language_edges(spark, edge, none):
    model = L.train(edge)
    out = L.predict(edge, model).collect()
    assert len(out) == edge.count()
    for r in out:
        if r["doc_id"] in (2, 3, 4, -4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.langs
    assert L.predict(none, model).collect() == []
    assert {r["lang_pred"] for r in L.predict(edge, L.train(none)).collect()} == {"und"}


def _long_texts(langs, chars):
    """A few long documents in each of many languages, each language with letters of its own."""
    rng, rows = np.random.default_rng(5), []
    for i in range(6 * langs):
        own = [chr(0x100 + 12 * (i % langs) + k) for k in range(12)]
        rows.append((i, " ".join("".join(rng.choice(own, 4)) for _ in range(chars // 5)), f"l{i % langs:02d}"))
    return rows


def test_languages_of_few_long_documents(spark):
    rows = _long_texts(20, 20_000)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.train(d, sample_bytes=100_000)
    assert model.langs == sorted({g for _, _, g in rows})
    pred = {r["doc_id"]: r["lang_pred"] for r in L.predict(d, model).collect()}
    assert pred == {i: g for i, _, g in rows}


def test_sample_is_bounded_and_shared(spark):
    rows = _long_texts(4, 20_000) + [(1000 + i, "short text", "s") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {}
    for i, t, g in rows:
        if not out_of_training(i):
            whole[g] = whole.get(g, 0) + len(t.encode())
    for most in (100_000, 20_000, 50):
        model = L.train(d, sample_bytes=most)
        codes, _, _, _ = model.tables[0]
        assert model.langs == sorted(whole) and len(codes) <= most
    from pyspark.sql import functions as F

    most = 100_000
    texts = d.where(~held_out(F.col("doc_id"))).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("doc"), F.octet_length("text").alias("size")
    )
    got = {r["lang"]: r["n"] for r in L._sample(texts, most).groupBy("lang").agg(F.sum(F.octet_length("piece")).alias("n")).collect()}
    assert sum(got.values()) <= most
    assert all(min(whole[g], most / 5 - L.PIECE) <= got[g] <= most / 5 for g in whole)


def test_pieces_count_like_whole_texts(spark):
    rows = [(i, "é" + "abcdefgh" * 2000 + f" {i}", g) for i, g in [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (7, "b")]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = {}
    for i, t, g in rows:
        if not out_of_training(i):
            training.setdefault(g, []).append(t.encode())
    a, b = L.train(d), model_of(training)
    assert a.langs == b.langs
    assert all(np.array_equal(x, y) for s, t in zip(a.tables, b.tables) for x, y in zip(s, t))


def test_long_texts_are_read_in_runs(monkeypatch):
    """Runs of passages give the features of the whole text, words of any length too, and their sums
    the score of the whole."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcÉZ9,.")) for _ in range(rng.integers(1, 12))) for _ in range(1500)]
    words[700] = "x9," * 3000
    texts = [" ".join(words), "  \n" + "\t".join(words[:350]) + " ", "y" * 9000, "", None, " ".join(words[:90])]
    whole, n = Q.encode(texts)
    net = Q.fit(whole, n, np.array([1, 0, 1, 0, 1, 0], dtype=np.float32), np.ones(6, dtype=np.float32), epochs=3)
    want = net.score(whole, n)
    monkeypatch.setattr(Q, "CHUNK", 700)
    parts, m = Q.encode(texts)
    assert m.tolist() == n.tolist() and np.allclose(parts, whole, atol=1e-6)
    assert np.allclose(net.score_texts(texts), want, atol=2e-6)
    assert Q.encode(texts, most=3)[1].tolist() == [0, 0, 1, 1, 1, 1]


def test_forward_pass_document_by_document(spark, docs):
    """Scores of the query against a plain forward pass in float64, passage by passage."""
    network = Q.train(docs, spark.read.parquet(f"/root/testdata/sf0.001/labels.parquet"))
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    got = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, network).collect()}
    for r in docs.collect():
        x, _ = Q.encode([r["text"]])
        weights, hidden = [], []
        for row in x.astype(np.float64):
            h = np.tanh(row @ p["W"] + p["b"])
            hidden.append(h)
            weights.append(float(np.sum(p["w"] * np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))))
        a = np.exp(np.array(weights) - max(weights))
        z = (a[:, None] * np.array(hidden)).sum(axis=0) / a.sum()
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-4
