from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tradelake.llm import token_counts as C
from tradelake.llm import token_files as F
from tradelake.llm import tokens as K
from tradelake.llm.common import scratch_path

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
PLAIN = Tokenizer.from_file(WORDS)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n.,'ABab́Σİ<|>"))))
def test_word_encoder_equals_the_tokenizer(text):
    got = np.frombuffer(K.word_encoder(WORDS).encode(text), dtype="<u2").tolist()
    assert got == plain_ids(text)


def test_words_whose_lower_case_has_marks():
    """A final mark is split off only where the normalised word is letters too: U+0130 becomes i and a
    combining dot, which stays with the mark behind it."""
    e = K.word_encoder(WORDS)
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not PLAIN.normalizer.normalize_str(chr(c)).isalpha()]
    assert "\u0130" in odd
    for c in odd:
        for t in ("AİA. Bİ, end", f"a{c}, {c}. x{c}y.", f"{c},{c} {c}.."):
            assert np.frombuffer(e.encode(t), dtype="<u2").tolist() == plain_ids(t), (c, t)


def test_word_encoder_equals_the_tokenizer_on_random_strings():
    rng = np.random.default_rng(7)
    pools = [(0x20, 0x7F), (0xA0, 0x24F), (0x300, 0x3FF), (0x400, 0x52F), (0x1E00, 0x1FFF), (0x2000, 0x2BFF), (0x3000, 0x9FFF), (0x1F000, 0x1FAFF)]
    e = K.word_encoder(WORDS)
    texts = []
    for _ in range(20_000):
        lo, hi = pools[rng.integers(len(pools))]
        chars = [chr(c) for c in rng.integers(lo, hi, rng.integers(1, 14))]
        texts.append("".join(x + str(rng.choice(["", "", ".", ",", " ", "İ"])) for x in chars))
    for t, want in zip(texts, PLAIN.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(e.encode(t), dtype="<u2").tolist() == want.ids, t


def test_word_encoder_forgets_and_goes_on():
    e = K.WordEncoder(WORDS, limit=600)
    for t in ("one two three four five, Six. seven", "one two"):
        assert np.frombuffer(e.encode(t), dtype="<u2").tolist() == plain_ids(t)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    out = []
    for r in rows:
        ids = np.array([*plain_ids(r["text"]), 1], dtype="<u4")
        out.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_files_round_trip(spark, docs, edge, none):
    for d in (docs, edge):
        folder = scratch_path(spark, "tf")
        manifest = F.write_token_files(d, WORDS, folder, length=64)
        rows = sorted(F.read_documents(manifest).collect(), key=lambda r: r["start"])
        assert sorted((r["doc_id"] or -99, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
            (i or -99, n, c) for i, n, c in expected(d.collect())
        )
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert F.token_files(none, WORDS).collect() == []


def test_sequences_are_of_equal_length_with_masks(spark, docs):
    manifest = F.write_token_files(docs, WORDS, scratch_path(spark, "tf"), length=128).collect()
    for f in manifest:
        reader = F.open_sequences(f["path"])
        n = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        assert n == -(-f["n_tokens"] // 128)
        masks = 0
        for row in range(n):
            ids, mask = F.sequence(reader, row)
            assert len(ids) == len(mask) == 128
            masks += int(mask.sum())
        assert masks == f["n_tokens"]


def test_token_counts(spark, docs, edge, none):
    enc = K.rank_encoder(RANKS)
    for d in (docs, edge):
        got = C.document_counts(d, RANKS)
        want = sorted((r["doc_id"] or -99, len(enc.encode_ordinary(r["text"] or ""))) for r in d.collect())
        assert sorted((r["doc_id"] or -99, r["n_tokens"]) for r in got.collect()) == want
    assert C.document_counts(none, RANKS).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_against_split(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    paths, want = [], []
    for k, n in enumerate((0, 1, 2, 50, 400)):
        ids = rng.integers(0, 4, n)
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.astype("<u2").tobytes())
        paths.append((str(path),))
        start = ordinal = 0
        for i, x in enumerate([*ids, None]):
            if x == 3 or (x is None and start < n):
                want.append((str(path), ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
    got = C.separator_scan(spark.createDataFrame(paths, "path string"), 3, 4, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
