"""Language of documents by prediction by partial matching over bytes.

For each language, byte contexts of every length up to ``ORDER`` are counted in a bounded sample
of its training texts, and frozen.  The code length of a byte after its context is -log2(c / (n + t))
if it was seen there (c of n times, t different bytes seen); else the escape -log2(t / (n + t)) is
paid and the next shorter context is asked; a context never seen costs nothing; below order 0 a
byte costs 8 bits.  A text begins after ORDER zero bytes.  The language with the shortest code of the
whole text wins; its score is the posterior under equal priors.

Counting runs in Spark over at most ``sample_bytes`` of text in all, shared equally by the
languages; that bounds the tables.  Texts are drawn by hash in pieces of at most ``PIECE`` bytes, each
counted after the bytes before it in its text, so a language gets its share (to within a piece, and
at least one piece) however long its documents are.  Scoring reads every byte of every text.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything
if there is nothing to learn from; ties go to the smaller language value; a null doc_id counts as
held out; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

ORDER = 4
CHUNK = 4_000_000  # bytes coded together
PIECE = 1024  # bytes drawn together; small, so that a sample meets many documents


def context_codes(text: bytes, before: bytes = bytes(ORDER)) -> np.ndarray:
    """For every byte the number made of the ORDER bytes before it and itself."""
    b = np.frombuffer(before + text, dtype=np.uint8).astype(np.uint64)
    code = np.zeros(len(text), dtype=np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | b[k : k + len(text)]
    return code


def _tail(code: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return code & np.uint64((1 << (8 * n)) - 1)


class ByteModel:
    """Code lengths of all languages.  ``counts``: columns lang, code (ORDER + 1 bytes), n."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.tables = []  # by order: seen codes, their bits by language, contexts, escape bits
        lower = None
        for order in range(ORDER + 1):
            whole = _tail(counts["code"].to_numpy().astype(np.uint64), order + 1)
            codes = np.unique(whole)
            contexts = np.unique(codes >> np.uint64(8))
            seen = np.zeros((len(codes), len(self.langs)))
            for j, lang in enumerate(self.langs):
                own = (counts["lang"] == lang).to_numpy()
                seen[:, j] = np.bincount(np.searchsorted(codes, whole[own]), weights=counts["n"].to_numpy()[own], minlength=len(codes))
            at = np.searchsorted(contexts, codes >> np.uint64(8))
            n, t = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(n, at, seen)
            np.add.at(t, at, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(t > 0, np.log2((n + t) / t), 0.0)
                direct = np.log2((n + t)[at] / seen)
            shorter = np.full((len(codes), len(self.langs)), 8.0) if lower is None else self._bits(lower, codes, order - 1)
            bits = np.where(seen > 0, direct, escape[at] + shorter)
            self.tables.append((codes, bits.astype(np.float32), contexts, escape.astype(np.float32)))
            lower = self.tables

    def _bits(self, tables, codes: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros((len(codes), len(self.langs)))
        open_ = np.arange(len(codes))
        for k in range(order, -1, -1):
            seen, bits, contexts, escape = tables[k]
            code = _tail(codes[open_], k + 1)
            i = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
            hit = seen[i] == code
            out[open_[hit]] += bits[i[hit]]
            open_, code = open_[~hit], code[~hit]
            i = np.minimum(np.searchsorted(contexts, code >> np.uint64(8)), len(contexts) - 1)
            known = contexts[i] == code >> np.uint64(8)
            out[open_[known]] += escape[i[known]]
        out[open_] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        group, held = [], 0
        for i, t in enumerate(texts):
            for lo in range(0, len(t), CHUNK):
                group.append((i, context_codes(t[lo : lo + CHUNK], t[max(0, lo - ORDER) : lo].rjust(ORDER, b"\0"))))
                held += len(group[-1][1])
                if held >= CHUNK:
                    self._add(out, group)
                    group, held = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
        """Equal bytes after equal contexts are looked up once for all texts of the group."""
        shift = np.uint64(24)
        for g in range(0, len(group), 1 << 24):
            part = group[g : g + (1 << 24)]
            key = np.sort(np.concatenate([(c << shift) | np.uint64(j) for j, (_, c) in enumerate(part)]))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(key)))
            key = key[first]
            text = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
            code = key >> shift
            fresh = np.concatenate(([True], code[1:] != code[:-1]))
            bits = self._bits(self.tables, code[fresh], ORDER)
            which = np.cumsum(fresh) - 1
            owner = np.array([i for i, _ in part])
            for j in range(len(self.langs)):
                total = np.bincount(text, weights=bits[which, j] * times, minlength=len(part))
                np.add.at(out[:, j], owner, total)


def _sample(d: DataFrame, sample_bytes: int) -> DataFrame | None:
    """lang, piece, before (up to ORDER bytes) of at most ``sample_bytes`` of text.  ``d``: lang, text,
    doc (hash), size.  A language's pieces come in the order of their hash, the first piece of its
    least document before all, until its share is full."""
    stats = d.groupBy("lang").agg(F.sum("size").alias("n"), F.min("doc").alias("least")).collect()  # one for each language
    if not stats:
        return None
    share = sample_bytes / len(stats)
    piece = max(1, min(PIECE, int(share)))
    more = 1 + 4 * (piece / share) ** 0.5  # bytes drawn deviate by sqrt(piece * share) at most
    limits = [(r["lang"], int((1 << 53) * min(1.0, more * share / r["n"])), r["least"]) for r in stats]
    limits = d.sparkSession.createDataFrame(limits, "lang string, below long, least long")
    first = F.col("doc") == F.col("least")
    draw = lambda j: F.when(first & (j == 0), F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64("doc", j), 11))
    chosen = F.filter(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / piece).cast("int")), lambda j: draw(j) < F.col("below"))
    cut = lambda b, j: F.struct(
        draw(j).alias("draw"), b.substr(j * piece + 1, F.lit(piece)).alias("piece"),
        b.substr(F.greatest(j * piece - ORDER, F.lit(0)) + 1, F.least(j * piece, F.lit(ORDER))).alias("before"),
    )
    # the outer transform makes a text's bytes once for all its pieces
    pieces = F.transform(F.array(F.col("text").cast("binary")), lambda b: F.transform(chosen, lambda j: cut(b, j)))[0]
    drawn = d.join(F.broadcast(limits), "lang").select("lang", F.explode(pieces).alias("p")).select("lang", "p.*")
    upto = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)  # a few shares at most
    return drawn.withColumn("upto", F.sum(F.octet_length("piece")).over(upto)).where(F.col("upto") <= max(share, 1)).select("lang", "piece", "before")


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 8_000_000
) -> ByteModel | None:
    """Learn from documents that are not held out and have a language."""
    d = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    d = d.where(F.col(text_col) != "").select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.octet_length(F.col(text_col)).alias("size"),
    )
    part = _sample(d, sample_bytes)
    if part is None:
        return None

    def count(batches):
        for b in batches:
            frame = b.to_pandas()
            for lang, own in frame.groupby("lang"):
                codes = [context_codes(t, c.rjust(ORDER, b"\0")) for t, c in zip(own["piece"], own["before"])]
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(code), "code": code.astype(np.int64), "n": n})

    counts = part.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.toPandas()
    return ByteModel(counts) if len(counts) else None


def predict(docs: DataFrame, model: ByteModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; whole texts."""
    d = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"),
    )
    if model is None:
        return d.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def code(batches):
        m = shared.value
        names = np.array(m.langs, dtype=object)
        for b in batches:
            texts = b["text"].to_pylist()
            bits = m.code_lengths([(t or "").encode("utf-8", "replace") for t in texts])
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            none = np.array([t is None for t in texts], dtype=bool)
            pred = np.where(none, "und", names[best]) if len(texts) else []
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(list(pred), pa.string()), pa.array(np.where(none, 0.0, score), pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return d.mapInArrow(code, f"doc_id {dict(d.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
