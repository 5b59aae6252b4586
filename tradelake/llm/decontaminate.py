"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are lower-cased and white space becomes one blank.  Every benchmark item is cut into
overlapping windows of ``window`` characters (a shorter item is one window).  If a document holds
a region within e edits of a window of m characters, the two share at least m - q + 1 - q*e
character q-grams on diagonals (document position minus window position) at most e apart.  So all
shared q-grams are counted in overlapping bands of diagonals; only bands that reach that bound are
kept, and each kept region is verified by an alignment restricted to its band.

The benchmark is taken in blocks of at most ``block_chars`` characters; each block goes to the
tasks as one bounded table, and every block meets all documents, so a larger benchmark costs more
passes, not more memory.  Documents are never shuffled.

Defined results: null and empty texts match nothing; items below ``min_chars`` normalised
characters are too short to tell a leak from chance and match nothing; repeated items and repeated
documents each give their rows; very long texts are taken in overlapping segments; empty tables
give no rows; extra columns pass through ``decontaminated`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

Q = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 400_000  # characters looked at together; bounds the memory of a task
GAP = np.uint32(0x110000)  # no character; separates texts


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of each run of Q = 8 characters, by doubling."""
    h, step, power = c.astype(np.uint64), 1, BASE
    with np.errstate(over="ignore"):
        while step < Q:
            h = h[:-step] * power + h[step:]
            step, power = 2 * step, power * power
        return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of one block of benchmark items and the index of their q-grams."""

    def __init__(self, items: list[tuple], window: int, rate: float, min_chars: int):
        self.window, self.item, self.at, self.text = window, [], [], []
        for item_id, text in items:
            t = normal(text)
            if len(t) < max(min_chars, Q):
                continue
            last = max(0, len(t) - window)
            for at in sorted({*range(0, last + 1, window // 4), last}):
                self.item.append(item_id)
                self.at.append(at)
                self.text.append(codes(t[at : at + window]))
        m = np.array([len(t) for t in self.text], dtype=np.int64)
        self.length = m
        self.edits = np.minimum((m * rate).astype(np.int64), (m - Q) // Q)
        self.need = m - Q + 1 - Q * self.edits  # at least 1
        self.step = int(self.edits.max(initial=0)) + 1  # bands overlap by half
        grams = [gram_hashes(t) for t in self.text]
        gram = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.pos = owner[order], pos[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.bits = 23
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._slot(self.gram)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, window, window position) of every shared q-gram."""
        h = gram_hashes(c)
        at = np.flatnonzero(self.seen[self._slot(h)])
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        same = self.gram[k] == h[at]
        at, k = at[same], k[same]
        # a window needs `need` hits within its length plus its edits; where hits are thinner, none can be
        reach = int((self.length + self.edits).max())
        near = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach)
        dense = near >= int(self.need.min())
        at, k = at[dense], k[dense]
        n = self.count[k]
        each = np.repeat(np.arange(len(k)), n)
        i = self.first[k][each] + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
        return at[each], self.owner[i], self.pos[i]

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of every band that reaches its window's bound."""
        at, w, pos = self.hits(c)
        offset = self.window + 2 * self.step  # keeps diagonals positive
        band = (at - pos + offset) // self.step
        width = np.int64(len(c) // self.step + self.window + 8)
        key, n = np.unique(w * width + band, return_counts=True)
        # band b holds the diagonals of steps b and b + 1
        both = np.concatenate([key, key - 1])
        total = np.concatenate([n, n])
        key, inv = np.unique(both, return_inverse=True)
        total = np.bincount(inv, weights=total).astype(np.int64)
        keep = total >= self.need[key // width]
        w, band = key[keep] // width, key[keep] % width
        return w, band * self.step - offset

    def verify(self, c: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of a whole window against any part of the text that stays in the band (its
        diagonals and ``step`` more on either side), and where that part ends."""
        best, end = np.empty(len(w), dtype=np.int64), np.empty(len(w), dtype=np.int64)
        for lo in range(0, len(w), 4096):
            part = slice(lo, lo + 4096)
            best[part], end[part] = self._align(c, w[part], first[part])
        return best, end

    def _align(self, c, w, first):
        width = 4 * self.step
        start = first - self.step  # diagonal of column 0
        m = self.length[w]
        longest = int(m.max())
        pattern = np.full((len(w), longest), GAP + 1, dtype=np.uint32)
        for r, i in enumerate(w):
            pattern[r, : m[r]] = self.text[i]
        padded = np.concatenate([np.full(longest + 3 * width, GAP), c, np.full(longest + 3 * width, GAP)])
        base = start + longest + 3 * width
        cols = np.arange(width)
        cost = np.zeros((len(w), width), dtype=np.int32)  # row 0: a match may begin anywhere
        out, end = np.empty(len(w), dtype=np.int64), np.empty(len(w), dtype=np.int64)
        big = np.int32(1 << 20)
        for i in range(longest):
            text = padded[(base + i)[:, None] + cols]  # column k, row i: text position start + i + k
            miss = (text != pattern[:, i : i + 1]).astype(np.int32)
            delete = np.concatenate([cost[:, 1:] + 1, np.full((len(w), 1), big, dtype=np.int32)], axis=1)
            cost = np.minimum(cost + miss, delete)
            cost = np.minimum.accumulate(cost - cols, axis=1) + cols  # insertions run along a row
            done = np.flatnonzero(m == i + 1)
            if len(done):
                k = cost[done].argmin(axis=1)
                out[done], end[done] = cost[done, k], start[done] + i + k + 1
        return out, end


def find(texts: Iterable[str | None], windows: Windows) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, window, edits, end in the normalised text) of the verified regions; at most
    one for each text and item: least edits, then first end."""
    overlap = 2 * windows.window
    group: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def search():
        gap = np.full(windows.window + 2 * windows.step, GAP)
        parts, starts, at = [], [], 0
        for _, _, c in group:
            parts += [c, gap]
            starts.append(at)
            at += len(c) + len(gap)
        c = np.concatenate(parts)
        w, first = windows.candidates(c)
        edits, end = windows.verify(c, w, first)
        ok = edits <= windows.edits[w]
        seg = np.searchsorted(starts, end[ok] - 1, side="right") - 1
        for s, i, e, z in zip(seg, w[ok], edits[ok], end[ok]):
            yield group[s][0], int(i), int(e), int(z - starts[s] + group[s][1])

    best: dict[tuple, tuple] = {}
    if not len(windows.gram):
        return
    for n, text in enumerate(texts):
        c = codes(normal(text))
        for lo in range(0, max(1, len(c) - overlap), SEGMENT):
            piece = c[lo : lo + SEGMENT + overlap]
            if len(piece) >= Q:
                group.append((n, lo, piece))
                held += len(piece)
            if held >= SEGMENT:
                for t, i, e, z in search():
                    key = (t, windows.item[i])
                    best[key] = min(best.get(key, (e, z, windows.at[i])), (e, z, windows.at[i]))
                group, held = [], 0
    if group:
        for t, i, e, z in search():
            key = (t, windows.item[i])
            best[key] = min(best.get(key, (e, z, windows.at[i])), (e, z, windows.at[i]))
    for (t, item), (e, z, at) in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1]))):
        yield t, item, e, z, at


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> list[list[tuple]]:
    """The benchmark in blocks of about ``block_chars`` characters, dealt by hash."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    own = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[tuple(r) for r in b.where(own == k).collect()] for k in range(n)]



def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 100,
    rate: float = 0.1,
    min_chars: int = 32,
    block_chars: int = 10_000_000,
) -> DataFrame:
    """Rows for contaminated documents only: doc_id, item_id, edits, item_start (of the window),
    text_end (end of the region in the normalised text)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = dict(d.dtypes)["doc_id"], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, item_start int, text_end long"
    out = d.sparkSession.createDataFrame([], schema)
    spark = d.sparkSession
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(items)  # at most block_chars characters

        def search(batches, shared=shared):
            windows = Windows(shared.value, window, rate, min_chars)
            for b in batches:
                found = list(find((t.as_py() for t in b["text"]), windows))
                if found:
                    t, item, e, z, at = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_id"].take(pa.array(t)), pa.array(item), pa.array(e, pa.int32()), pa.array(at, pa.int32()), pa.array(z, pa.int64())],
                        names=["doc_id", "item_id", "edits", "item_start", "text_end"],
                    )

        out = out.unionByName(d.mapInArrow(lean(search), schema))
    return out


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 100,
    rate: float = 0.1,
    min_chars: int = 32,
    block_chars: int = 10_000_000,
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark region."""
    spark = docs.sparkSession
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches, shared=shared):
            windows = Windows(shared.value, window, rate, min_chars)
            for b in batches:
                bad = {t for t, *_ in find((t.as_py() for t in b[text_col]), windows)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(lean(keep), docs.schema)
    return docs
