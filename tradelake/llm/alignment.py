"""Token correspondences of two tokenizers, counted over a corpus by inverted pair bitmaps.

Both tokenizers encode a text (A a space and the text, B the text, before which it puts a space); the
byte offsets where an A token and a B token both end cut the tokens into groups, and the two tokens
that end there are linked.  A pair of ids is counted over the whole corpus, and each document gets its
links back with those counts as scores.

The index has, for every pair and chunk of documents, bit planes: plane j is the set of the
documents in the chunk that hold the pair with bit j set in its number of links.  A plane is a
compressed bitmap (sorted 16-bit positions while these are few, else a bit set).  The planes' union
counts documents, the planes' population counts weighted by 2^j count links.  Only these sums are
grouped by pair; pairs that are most frequent for their B id are marked; the postings then meet their
pair's count and go back to their chunk, whose documents add up the scores.

On Spark: one scan encodes texts (both tokenizers never put a token across a space that follows a
non-space, so words between such spaces are encoded once and remembered by the worker, within a bound
in bytes) and writes each document's distinct pairs; the index is built from that table in chunks
of at most 65,536 documents and a bounded number of postings; a frequent pair is one row for each
chunk, so no key holds more rows than there are chunks.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for
byte, have no tokens (zeros and an empty groups_sha256); repeated rows and equal ids each get a row
and count each; ties for the most frequent pair of a B id all count as best; an empty table gives no
rows; only id and text are read, other columns may have any name; a very long text is encoded in
pieces of about a megabyte (a run without a space that follows a non-space is one piece).
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pinned
from .tokens import byte_characters

CUT = re.compile(r"(?<=\S) ")
PIECE = 1 << 20
MEMORY = 96 << 20  # bytes of remembered words in a worker
CHUNK_DOCS = 1 << 16
CHUNK_POSTINGS = 2_000_000
PLANES = "array<struct<plane:tinyint,docs:binary>>"


@lru_cache(maxsize=2)
def _byte_tokenizer(path: str):
    """Encoder of the byte-level tokenizer in a JSON file, and the bytes of its ids.  Its ids are the
    ranks of its merges, so tiktoken encodes with the same vocabulary, with less work for each call;
    strings of special tokens are plain text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    byte_of = {c: b for b, c in byte_characters().items()}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    entry = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if all(c in byte_of for c in t)}
    special = {i for t, i in vocabulary.items() if t.startswith("<|") and t.endswith("|>")}
    ranks = {t: i for i, t in entry.items() if i not in special}
    name = os.path.basename(path)
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), entry


@lru_cache(maxsize=2)
def _piece_tokenizer(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    entry = [
        bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)
    ]
    return sp, entry


class Aligner:
    """Groups and linked pairs of texts.  Words are remembered up to ``memory`` bytes, in two halves: when
    the newer one is full the older one is dropped, and a word met again moves to the newer."""

    def __init__(self, byte_path: str, piece_path: str, memory: int = MEMORY):
        self.a, self.bytes_a = _byte_tokenizer(byte_path)
        self.b, self.bytes_b = _piece_tokenizer(piece_path)
        self.size_a = {i: len(t) for i, t in self.bytes_a.items()}
        self.size_b = list(map(len, self.bytes_b))
        self.text_a, self.text_b = {i: str(i) for i in self.bytes_a}, list(map(str, range(len(self.bytes_b))))
        self.stride = len(self.bytes_b)  # a pair's number is a * stride + b
        self.pair = "<u4" if len(self.bytes_a) * self.stride <= 1 << 32 else "<u8"
        self.kind = "I" if self.pair == "<u4" else "Q"
        self.space = self.b.piece_to_id("▁")
        self.memory, self.held = memory, 0
        self.words: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _align(self, word: str, a: list[int], b: list[int]) -> tuple | None:
        """groups, tokens of A, of B, groups' number, pairs; None where the bytes differ."""
        data = b" " + word.encode("utf-8", "replace")
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        size_a, size_b, text_a, text_b, stride = self.size_a, self.size_b, self.text_a, self.text_b, self.stride
        groups, pairs = [], []
        i0 = j0 = j = end_a = 0
        end_b = size_b[b[0]]
        for i, x in enumerate(a):
            end_a += size_a[x]
            while end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
            if end_b == end_a:
                y = b[j]
                left = text_a[x] if i == i0 else ",".join([text_a[k] for k in a[i0 : i + 1]])
                right = text_b[y] if j == j0 else ",".join([text_b[k] for k in b[j0 : j + 1]])
                groups.append(left + "|" + right)
                pairs.append(x * stride + y)
                i0, j0 = i + 1, j + 1
        return ";".join(groups).encode(), len(a), len(b), len(groups), array(self.kind, pairs).tobytes()

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        """Results of these words, from memory or new."""
        if self.held > self.memory // 2:
            self.older, self.words, self.held = self.words, {}, 0
        new = set(words).difference(self.words)
        if not new:
            return self.words
        older = [w for w in new if w in self.older]
        for w in older:
            self._keep(w, self.older[w])
        new = list(new.difference(older))
        if new:
            encode = self.a.encode_ordinary
            for w, b in zip(new, self.b.encode(new, num_threads=1)):
                self._keep(w, self._align(w, encode(" " + w), b or [self.space]))
        return self.words

    def _keep(self, word: str, r: tuple | None) -> None:
        self.words[word] = r
        self.held += 300 + 4 * len(word) + (len(r[0]) + len(r[4]) if r else 0)

    def text(self, text: str | None):
        """n_a, n_b, n_groups, n_links, sha256 of the groups, pair numbers (one for each link)."""
        digest, counts, pairs, at = hashlib.sha256(), [0, 0, 0], [], 0
        text = text or ""
        while at < len(text):
            border = CUT.search(text, at + PIECE)
            end = border.start() if border else len(text)
            words = CUT.split(text[at:end])
            known = self.learn(words)
            rows = [known[w] for w in words]
            if None in rows:
                return 0, 0, 0, 0, "", np.empty(0, dtype=self.pair)
            if at:
                digest.update(b";")
            digest.update(b";".join([r[0] for r in rows]))
            for k in range(3):
                counts[k] += sum([r[k + 1] for r in rows])
            pairs.append(b"".join([r[4] for r in rows]))
            at = end + 1 if border else end
            if border and at == len(text):  # the text ends with the space of this cut
                rest = self.learn([""])[""]
                digest.update(b";" + rest[0])
                counts = [c + x for c, x in zip(counts, rest[1:4])]
                pairs.append(rest[4])
        linked = np.frombuffer(b"".join(pairs), dtype=self.pair)
        return *counts, len(linked), digest.hexdigest() if counts[2] else "", linked


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """A worker's aligner: its next task goes on with the words it knows."""
    return Aligner(byte_path, piece_path)


def encoded(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct) and times."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def compute(batches):
        aligner = _aligner(byte_path, piece_path)
        for b in batches:
            columns = [[] for _ in range(7)]
            for t in b["text"]:
                *numbers, linked = aligner.text(t.as_py())
                pair, times = np.unique(linked, return_counts=True)
                for c, v in zip(columns, (*numbers, pair.astype(np.int64), times.astype(np.int32))):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    kind = dict(d.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return pinned(d.mapInArrow(lean(compute), schema), "alignment-pairs")


def containers(group: np.ndarray, position: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """Compressed bitmaps of sorted (group, position) rows: the groups, and their bytes.  An even
    length is a list of 16-bit positions, an odd one a bit set."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    bits = (-(-n_docs // 8)) | 1
    dense = 2 * sizes > bits
    offsets = np.r_[0, np.cumsum(np.where(dense, bits, 2 * sizes))].astype(np.int32)
    out = np.zeros(offsets[-1], dtype=np.uint8)
    listed = np.repeat(~dense, sizes)
    at = (np.repeat(offsets[:-1], sizes) + 2 * (np.arange(len(group)) - np.repeat(starts, sizes)))[listed]
    out[at], out[at + 1] = position[listed] & 0xFF, position[listed] >> 8
    for g in np.flatnonzero(dense):
        member = np.zeros(bits * 8, dtype=np.uint8)
        member[position[starts[g] : starts[g] + sizes[g]]] = 1
        out[offsets[g] : offsets[g + 1]] = np.packbits(member, bitorder="little")
    return group[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def positions(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the bitmap and position, for every member of these bitmaps."""
    if not len(bitmaps):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], dtype=np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1]
    data = np.frombuffer(bitmaps.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    dense = lengths % 2 == 1
    where = [np.repeat(np.flatnonzero(~dense), lengths[~dense] // 2)]
    found = [np.ascontiguousarray(data[np.repeat(~dense, lengths)]).view("<u2").astype(np.int64)]
    for g in np.flatnonzero(dense):
        lo = offsets[g] - offsets[0]
        member = np.flatnonzero(np.unpackbits(data[lo : lo + lengths[g]], bitorder="little"))
        where.append(np.full(len(member), g))
        found.append(member)
    return np.concatenate(where), np.concatenate(found)


def chunk_index(pair: np.ndarray, position: np.ndarray, times: np.ndarray, n_docs: int) -> dict[str, pa.Array]:
    """pair, docs, links, planes of one chunk's postings."""
    order = np.argsort(pair, kind="stable")  # documents come in order, so positions stay sorted
    pair, position, times = pair[order], position[order], times[order]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    docs = np.diff(np.r_[starts, len(pair)])  # members of the planes' union
    links = np.add.reduceat(times.astype(np.int64), starts)
    own = np.repeat(np.arange(len(starts)), docs)
    group, member = [], []
    for j in range(int(times.max()).bit_length()):
        has = (times >> j) & 1 == 1
        group.append(own[has] * 64 + j)
        member.append(position[has])
    group, member = np.concatenate(group), np.concatenate(member)
    order = np.argsort(group, kind="stable")
    group, bitmaps = containers(group[order], member[order], n_docs)
    planes = pa.StructArray.from_arrays([pa.array((group % 64).astype(np.int8)), bitmaps], names=["plane", "docs"])
    per_pair = np.bincount(group // 64, minlength=len(starts))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_pair)].astype(np.int32)), planes)
    return {"pair": pa.array(pair[starts]), "docs": pa.array(docs.astype(np.int64)), "links": pa.array(links), "planes": lists}


def pair_index(documents: DataFrame, chunk_docs: int = CHUNK_DOCS, chunk_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """chunk, pair, docs, links, planes; and for each chunk one row without a pair that lists its
    documents (``members``)."""
    fields = [f for f in documents.schema.fields if f.name not in ("pairs", "times")]
    names = [f.name for f in fields]
    member = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>"

    def build(batches):
        task, number = TaskContext.get().partitionId(), 0
        held, n_docs, n_postings = [], 0, 0

        def chunk():
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t["pairs"].combine_chunks(), t["times"].combine_chunks()
            lengths = np.diff(lists[0].offsets.to_numpy())
            pair, times = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
            position = np.repeat(np.arange(len(lengths)), lengths)
            columns = [t[n].combine_chunks() for n in names]
            members = pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), pa.StructArray.from_arrays(columns, names=names))
            none = pa.nulls(1, pa.int64())
            key = (task << 24) + number
            empty = pa.nulls(1, pa.list_(pa.struct([("plane", pa.int8()), ("docs", pa.binary())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), none, none, none, empty, members],
                names=["chunk", "pair", "docs", "links", "planes", "members"],
            )
            if len(pair):
                ix = chunk_index(pair, position, times, n_docs)
                n = len(ix["pair"])
                ix = {"chunk": pa.array(np.full(n, key)), **ix, "members": pa.nulls(n, members.type)}
                whole = pa.RecordBatch.from_pydict(ix)
                for lo in range(0, n, 65_536):
                    yield whole.slice(lo, 65_536)

        for b in batches:
            # cut the batch where a chunk is full; a document's postings stay together
            sizes = np.diff(b["pairs"].offsets.to_numpy())
            lo = 0
            for i, size in enumerate(sizes.tolist()):
                if n_docs and (n_docs >= chunk_docs or n_postings + size > chunk_postings):
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    yield from chunk()
                    held, n_docs, n_postings, number, lo = [], 0, 0, number + 1, i
                n_docs, n_postings = n_docs + 1, n_postings + size
            if len(sizes) > lo:
                held.append(b.slice(lo))
        if n_docs:
            yield from chunk()

    schema = f"chunk long, pair long, docs long, links long, planes {PLANES}, members array<{member}>"
    return pinned(documents.mapInArrow(lean(build), schema), "alignment-index")


def pair_counts(index: DataFrame, stride: int) -> DataFrame:
    """pair, docs, links over the corpus, and whether no A id is linked more often to its B id."""
    counts = index.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair") % stride))  # at most A's vocabulary in rows
    return counts.withColumn("best", F.col("links") == most)


def scored(index: DataFrame, counts: DataFrame) -> DataFrame:
    """Members of all chunks with n_best and count_sum, from the postings of their pairs."""
    postings = index.where("pair is not null").select("chunk", "pair", "planes")
    rows = postings.join(counts.select("pair", F.col("links").alias("count"), "best"), "pair")
    rows = rows.select("chunk", "count", "best", "planes", F.lit(None).cast(index.schema["members"].dataType).alias("members"))
    heads = index.where("pair is null").select(
        "chunk", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), "planes", "members"
    )
    dealt = rows.union(heads).repartition("chunk").sortWithinPartitions("chunk", F.col("count").asc_nulls_first())
    fields = index.schema["members"].dataType.elementType.fields
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n_best long, count_sum long"
    names = [f.name for f in fields]

    def back(batches):
        members = best = total = None

        def done():
            for lo in range(0, len(members), 16_384):
                part = members.slice(lo, 16_384)
                columns = [part.field(n) for n in names] + [pa.array(x[lo : lo + 16_384]) for x in (best, total)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum"])

        for b in batches:
            heads = np.flatnonzero(b["members"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *heads], [*heads, b.num_rows]):
                if lo == hi:
                    continue
                if lo in heads:
                    if members is not None:
                        yield from done()
                    members = b["members"].slice(lo, 1).flatten()
                    best, total = np.zeros(len(members), dtype=np.int64), np.zeros(len(members), dtype=np.int64)
                    lo += 1
                if lo >= hi:
                    continue
                part = b.slice(lo, hi - lo)
                planes = part["planes"].flatten()
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part["planes"]).to_numpy())
                weight = np.left_shift(1, planes.field("plane").to_numpy().astype(np.int64))
                at, doc = positions(planes.field("docs"))
                count = part["count"].to_numpy()[row] * weight
                leading = part["best"].to_numpy(zero_copy_only=False)[row] * weight
                np.add.at(total, doc, count[at])
                np.add.at(best, doc, leading[at])
        if members is not None:
            yield from done()

    return dealt.mapInArrow(lean(back), schema)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(documents with scores, table of pairs: a_id, b_id, docs, links, best)."""
    stride = len(_piece_tokenizer(piece_path)[1])
    index = pair_index(encoded(docs, byte_path, piece_path, id_col, text_col))
    counts = pinned(pair_counts(index, stride), "alignment-counts")
    pairs = counts.select(
        F.expr(f"pair div {stride}").alias("a_id"), (F.col("pair") % stride).alias("b_id"), "docs", "links", "best"
    )
    return scored(index, counts), pairs


def alignment_digest(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    documents, _ = alignment(docs, byte_path, piece_path)
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
