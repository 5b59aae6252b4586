"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded from its bytes:
hashed three-byte groups, and shares of letters, marks, digits, capitals, repeated and distinct
words.  A gated attention network learns from document labels alone which passages tell: each
passage gets a weight, and the weighted mean of the passage representations is scored.

The network is fitted with numpy on the driver, on about ``train_docs`` labelled documents (half of
each label, chosen by hash, weighted by the square root of their true shares) of at most
``train_passages`` passages each; documents of more passages are not learned from.  These two
parameters bound what is collected.  Scoring reads every passage of every
document inside Spark tasks.

Defined results: null, empty and blank texts are one empty passage and get its score; documents
labelled both ways, and null labels, are not learned from; of several texts of one id the one with
the fewest passages, then the least features, is learned from; a very long text is read in runs of
about CHUNK bytes and its passages' weighted sums are carried on (a word of any length too); without two labels to learn from every
score is the share of label 1 (0.5 without labels); repeated rows get equal scores; a null doc_id
counts as held out; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, pieces

PASSAGE = 100  # words
GROUPS = 256  # hashed three-byte groups
SHAPE = 9
CHUNK = 400_000  # bytes encoded together; bounds the memory of a task

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.arange(256)
_KINDS = [
    (_BYTE >= 65) & (_BYTE <= 90),  # capitals
    (_BYTE >= 48) & (_BYTE <= 57),  # digits
    (_BYTE == 44) | (_BYTE == 46),  # comma, full stop
    (_BYTE >= 33) & (_BYTE <= 126) & ~np.isin(_BYTE, [44, 46]) & ~np.array([chr(b).isalnum() for b in range(256)]),  # other marks
    _BYTE >= 128,
]


def runs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A text in runs of whole passages of about CHUNK bytes, and the two bytes after each."""
    held, some = b"", False
    for piece in pieces(data, CHUNK):
        held += piece
        space = _SPACE[np.frombuffer(held, dtype=np.uint8)]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        whole = (len(start) - 1) // PASSAGE * PASSAGE
        if whole > 0:
            cut, some = int(start[whole]), True
            yield held[:cut], held[cut : cut + 2]
            held = held[cut:]
    if held or not some:
        yield held, b""


def encode_run(run: bytes, tail: bytes) -> np.ndarray:
    """Features of a run's passages; passages with very long words are read in slices."""
    if len(run) <= 4 * CHUNK:
        return _encode([run], [tail])[0]
    space = _SPACE[np.frombuffer(run, dtype=np.uint8)]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    cuts = [0, *start[PASSAGE::PASSAGE].tolist(), len(run)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        after = run[hi : hi + 2] if hi < len(run) else tail
        small = hi - lo <= 4 * CHUNK
        out.append(_encode([run[lo:hi]], [after])[0] if small else _wide_passage(run[lo:hi], after))
    return np.concatenate(out)


def _wide_passage(data: bytes, tail: bytes) -> np.ndarray:
    """`_encode` of one passage, in slices of CHUNK bytes."""
    words = [w.lower() for w in data.split()]
    counts, kinds, n_bytes = np.zeros(GROUPS, dtype=np.int64), np.zeros(len(_KINDS)), 0
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK + 2]
        part += (tail + b"\n\n")[: max(0, min(2, lo + CHUNK + 2 - len(data)))]
        b = np.frombuffer(part, dtype=np.uint8)
        low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
        h = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
        own = b[:-2]
        counts += np.bincount(h[~_SPACE[own]], minlength=GROUPS)
        kinds += [k[own].sum() for k in _KINDS]
        n_bytes += int((~_SPACE[own]).sum())
    g = np.sqrt(counts.astype(np.float32))
    x = np.zeros((1, GROUPS + SHAPE), dtype=np.float32)
    x[0, :GROUPS] = 4 * g / max(np.sqrt((g * g).sum()), 1)
    n = len(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    shape = [*(kinds / max(n_bytes, 1)), again / n, len(set(words)) / n, min(n_bytes / n, 20) / 10, min(n, PASSAGE) / PASSAGE]
    x[0, GROUPS:] = 3 * np.array(shape)
    return x


def groups(texts: Iterable[str | None]) -> Iterator[list[bytes] | bytes]:
    """Texts to be encoded together, as a list of about CHUNK bytes; a longer text by itself."""
    group, held = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "replace")
        if len(b) > CHUNK:
            if group:
                yield group
            yield b
            group, held = [], 0
            continue
        group.append(b)
        held += len(b)
        if held >= CHUNK:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode(texts: Iterable[str | None], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, number of passages of each text); a text has at least one passage.  A text
    of more than ``most`` passages gives none."""
    parts, counts = [np.empty((0, GROUPS + SHAPE), dtype=np.float32)], [np.empty(0, dtype=np.int64)]
    for g in groups(texts):
        if isinstance(g, list):
            x, n = _encode(g)
        else:
            own, total = [], 0
            for run, tail in runs(g):
                own.append(encode_run(run, tail))
                total += len(own[-1])
                if most is not None and total > most:
                    own, total = [], 0
                    break
            x, n = np.concatenate(own) if own else parts[0], np.array([total])
        parts.append(x)
        counts.append(n)
    return np.concatenate(parts), np.concatenate(counts)


def _encode(texts: list[bytes], tails: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts, or of runs of passages followed by ``tails`` (two bytes each)."""
    if not texts:
        return np.empty((0, GROUPS + SHAPE), dtype=np.float32), np.empty(0, dtype=np.int64)
    b = np.frombuffer(b"\n\n".join([*texts, b"\n"]), dtype=np.uint8)  # no group of three spans two texts
    true = b
    if tails and any(tails):
        true = np.frombuffer(b"".join([t + (tail + b"\n\n")[:2] for t, tail in zip(texts, tails)]) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))  # first byte of each word
    text_of = np.searchsorted(ends, start, side="right")
    words = np.bincount(text_of, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(passages) - passages
    in_text = np.arange(len(start)) - np.repeat(np.cumsum(words) - words, words)
    owner = first[text_of] + in_text // PASSAGE  # passage of each word
    total = int(passages.sum())
    x = np.zeros((total, GROUPS + SHAPE), dtype=np.float32)
    if not len(start):
        return x, passages
    word_of = np.cumsum(~space & np.concatenate(([True], space[:-1]))) - 1
    at = owner[np.maximum(word_of, 0)]  # passage of each byte; spaces go with the word before
    low = np.where((true >= 65) & (true <= 90), true + 32, true).astype(np.uint32)
    h = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
    own = ~space[:-2]  # groups start at a word's byte
    counts = np.bincount(at[:-2][own] * GROUPS + h[own], minlength=total * GROUPS).reshape(total, GROUPS)
    g = np.sqrt(counts.astype(np.float32))
    x[:, :GROUPS] = 4 * g / np.maximum(np.sqrt((g * g).sum(axis=1, keepdims=True)), 1)

    n_words = np.bincount(owner, minlength=total)
    n_bytes = np.bincount(at, weights=~space, minlength=total)
    shape = [np.bincount(at, weights=k[b], minlength=total) / np.maximum(n_bytes, 1) for k in _KINDS]
    place = (np.arange(len(b)) - start[np.maximum(word_of, 0)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (low.astype(np.uint64) + 1) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
        mixed ^= mixed >> np.uint64(31)
        mixed[space] = 0
        word = np.add.reduceat(mixed, start)
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])))
    order = np.lexsort((word, owner))
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    some = np.maximum(n_words, 1)
    shape.append(np.bincount(owner, weights=again, minlength=total) / some)
    shape.append(np.bincount(owner[order], weights=fresh, minlength=total) / some)
    shape.append(np.minimum(n_bytes / some, 20) / 10)
    shape.append(np.minimum(n_words, PASSAGE) / PASSAGE)
    x[:, GROUPS:] = 3 * np.stack(shape, axis=1)
    return x, passages


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """h = tanh(x W + b); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . z + d)
    with z the weighted mean of h."""

    p: dict[str, np.ndarray]
    prior: float = 0.5

    def forward(self, x, n):
        p, starts = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"][0]), (h, t, s, a, z)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(n), self.prior)
        return self.forward(x, n)[0].astype(np.float64).round(6)  # sums differ in the last bits between batches

    def score_texts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores of whole texts; a long one is summed run by run."""
        out = [np.empty(0)]
        for g in groups(texts):
            out.append(self.score(*_encode(g)) if isinstance(g, list) else self.score_runs(runs(g)))
        return np.concatenate(out)

    def score_runs(self, parts: Iterator[tuple[bytes, bytes]]) -> np.ndarray:
        if not self.p:
            return np.array([self.prior])
        p, most, total, z = self.p, -np.inf, 0.0, 0.0
        for run, tail in parts:
            h = np.tanh(encode_run(run, tail) @ p["W"] + p["b"])
            e = ((np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]).astype(np.float64)
            top = max(most, float(e.max()))
            weight = np.exp(e - top)
            total = total * np.exp(most - top) + weight.sum()
            z = z * np.exp(most - top) + weight @ h
            most = top
        return _sigmoid(np.array([z / total @ p["c"] + p["d"][0]], dtype=np.float64)).round(6)

    def gradients(self, x, n, y, weight):
        p = self.p
        out, (h, t, s, a, z) = self.forward(x, n)
        g = (out - y) * weight / weight.sum()
        dz = np.repeat(g[:, None] * p["c"][None, :], n, axis=0)
        da = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(a * da, np.cumsum(n) - n), n)
        de = a * (da - mean)
        dt, ds = de[:, None] * s * p["w"], de[:, None] * t * p["w"]
        dt, ds = dt * (1 - t * t), ds * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {
            "W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de,
            "c": z.T @ g, "d": np.array([g.sum()]),
        }


def fit(x, n, y, weight, hidden=24, gate=12, epochs=40, batch=64, rate=0.004, decay=1e-4, seed=11) -> Network:
    """Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {
        "W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)),
        "U": rng.normal(0, 0.3, (hidden, gate)), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1),
    }
    net = Network({k: v.astype(np.float32) for k, v in p.items()})
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(u) for k, u in net.p.items()}
    starts, step = np.cumsum(n) - n, 0
    for epoch in range(epochs):
        order = rng.permutation(len(n))
        for lo in range(0, len(n), batch):
            own = order[lo : lo + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in own])
            grad = net.gradients(x[rows], n[own], y[own], weight[own])
            step += 1
            lr = rate * (0.5 if epoch >= epochs // 2 else 1) * (0.3 if epoch >= epochs * 4 // 5 else 1)
            for k in net.p:
                g = grad[k] + decay * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_docs: int = 4000, train_passages: int = 400,
) -> Network:
    """Learn from labelled documents that are not held out."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        ~held_out(F.col("id")) & F.col("y").isin(0, 1)
    )
    lab = lab.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").drop("y1")
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return Network({}, prior)
    share = F.lit(0.0)
    for y, c in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, train_docs / 2 / c))).otherwise(share)
    picked = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * train_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def bags(batches):
        for b in batches:
            x, n = encode((t.as_py() for t in b["text"]), train_passages)
            starts = np.cumsum(n) - n
            keep = [i for i in range(len(n)) if 0 < n[i] <= train_passages]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b["id"].take(pa.array(keep, pa.int64())),
                    "y": b["y"].take(pa.array(keep, pa.int64())),
                    "n": pa.array(n[keep], pa.int32()),
                    "x": pa.array([x[starts[i] : starts[i] + n[i]].astype(np.float16).tobytes() for i in keep], pa.binary()),
                }
            )

    kind = dict(texts.dtypes)["id"]
    got = texts.mapInArrow(lean(bags), f"id {kind}, y int, n int, x binary").groupBy("id").agg(
        F.first("y").alias("y"), F.min(F.struct("n", "x")).alias("bag")
    ).select("id", "y", "bag.*")
    rows = sorted(got.collect(), key=lambda r: r["id"])
    if len({r["y"] for r in rows}) < 2:
        return Network({}, prior)
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float16).reshape(r["n"], -1) for r in rows]).astype(np.float32)
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    n = np.array([r["n"] for r in rows])
    seen = {k: max(1, int((y == k).sum())) for k in counts}
    weight = np.array([counts[int(k)] / seen[int(k)] for k in y], dtype=np.float32)
    weight = np.sqrt(weight / weight.mean())
    return fit(x, n, y, weight)


def quality_scores(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; whole texts."""
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches):
        for b in batches:
            s = shared.value.score_texts(t.as_py() for t in b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s)], names=["doc_id", "held_out", "score"])

    out = d.mapInArrow(lean(score), f"doc_id {dict(d.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_quality(docs: DataFrame, network: Network, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """``docs`` without the documents that score below ``cut``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def keep(batches):
        for b in batches:
            s = shared.value.score_texts(t.as_py() for t in b[text_col])
            yield b.filter(pa.array(s >= cut))

    return docs.mapInArrow(lean(keep), docs.schema)
