"""Mixing sources to target weights.

The words of each source are packed, in a hash order of its documents, into blocks of
``block_words`` words.  The output is a sequence of slots; each slot holds one block.  Every
output shard draws its source counts from a multinomial distribution, and the j-th slot of a
source reads block ``pi(j mod n)`` of that source, where ``pi`` is a pseudorandom permutation of
its ``n`` block numbers, a new one for each pass over the source.  Slots and blocks meet in an
equi-join on (source, block number).

A source's slots end where its target is reached (the last slot may take the first words of its
block only), so the words taken equal the rounded target; passes end before the cap, so no block
is read more often than the cap allows.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source
of its own, ordered last; repeated rows are separate documents; an empty table gives no rows;
only the three named columns are read, others (of any names) pass through ``mixed_documents``
unchanged; a very long text is counted by the JVM and cut as one value, without a list of its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, lean, mix64, pinned, word_count

#: Source tables up to this many rows are broadcast; beyond it the planner chooses.
BROADCAST_SOURCES = 10_000
#: Documents in one bucket of the packing order, on average.
BUCKET_DOCS = 2_000
#: Rows cut into runs together.
ROWS_CUT = 256


@dataclass(frozen=True)
class SourcePlan:
    """What one source contributes; one small object for each source."""

    index: int
    name: str | None
    size: int
    target: float
    blocks: int  # number of packed blocks
    slots: int  # slots that read from it
    last_words: int  # words that its last slot takes


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Split ``share`` x all words by weight; a target stops at ``cap`` x its source's size and
    the excess is shared again by weight among the others."""
    out = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    rest = share * sum(sizes)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


class Permutation:
    """Pseudorandom permutation of 0..n-1: a four-round Feistel network over the next even
    number of bits, walked until the value falls below n."""

    def __init__(self, n: int, *key: int):
        self.n = n
        half = (max(n - 1, 1).bit_length() + 1) // 2
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        base = np.uint64(0)
        for k in key:
            base = mix64(np.array([int(base) ^ (k + 0x9E3779B9)], dtype=np.uint64))[0]
        self.keys = mix64(np.arange(4, dtype=np.uint64) + base)

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if inverse else self.keys:
            if inverse:
                left, right = right ^ (mix64(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (left << self.half) | right

    def __call__(self, index, inverse: bool = False) -> np.ndarray:
        x = self._once(np.atleast_1d(np.asarray(index)).astype(np.uint64), inverse)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], inverse)
        return x.astype(np.int64)


def plan_source(index: int, name: str | None, size: int, target: float, block_words: int, seed: int) -> SourcePlan:
    blocks, words = -(-size // block_words), round(target)
    if not words:
        return SourcePlan(index, name, size, target, blocks, 0, 0)
    passes, rest = divmod(words, size)
    short = blocks * block_words - size  # words missing in the last block
    if not rest:
        last = int(Permutation(blocks, seed, index, passes - 1)(blocks - 1)[0])
        words_last = block_words - (short if last == blocks - 1 else 0)
        return SourcePlan(index, name, size, target, blocks, passes * blocks, words_last)
    at = int(Permutation(blocks, seed, index, passes)(blocks - 1, inverse=True)[0])
    n = -(-rest // block_words)
    if at < n:
        n = -(-(rest + short) // block_words)
    before = (n - 1) * block_words - (short if at < n - 1 else 0)
    return SourcePlan(index, name, size, target, blocks, passes * blocks + n, rest - before)


@dataclass
class Mix:
    """``documents``: _row (the kept columns, under any names), _sidx, _size, _start (first word in its
    source's packing); ``layout``: the last three alone, written; ``slots``: shard, slot, sidx, pass, block, words; ``sources``: one plan for each source."""

    documents: DataFrame
    layout: DataFrame
    slots: DataFrame
    sources: list[SourcePlan]
    block_words: int

    def source_table(self) -> DataFrame:
        spark = self.documents.sparkSession
        schema = "_sidx int, source_name string, source_size long, target double"
        return spark.createDataFrame([(s.index, s.name, s.size, s.target) for s in self.sources], schema)

    def pieces(self) -> DataFrame:
        """The packed blocks: one row for each part of a document in a block."""
        b = self.block_words
        last = F.col("_start") + F.col("_size") - 1
        d = self.layout.where("_size > 0")
        d = d.withColumn("block", F.explode(F.sequence(F.expr(f"_start div {b}"), F.floor(last / b))))
        first = F.greatest(F.col("_start"), F.col("block") * b)
        end = F.least(F.col("_start") + F.col("_size"), (F.col("block") + 1) * b)
        return d.select(
            F.col("_sidx").alias("sidx"), "block", F.col("_start").alias("doc_start"),
            (first - F.col("_start")).alias("first_word"), (end - first).alias("piece_words"),
            (first - F.col("block") * b).alias("offset"),
        )

    def taken(self) -> DataFrame:
        """Every use of a piece by a slot, joined by (source, block number): sidx, doc_start,
        pass, shard, slot, first_word, words (at least 1)."""
        # the planner takes the slots for as few as the rows they are expanded from; never broadcast them
        use = self.slots.hint("merge").join(self.pieces(), ["sidx", "block"])
        use = use.withColumn("words", F.least(F.col("piece_words"), F.col("slot_words") - F.col("offset")))
        return use.where("words > 0").select(
            "sidx", "doc_start", "pass", "shard", "slot", "first_word", "words"
        )


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 1024,
    shard_slots: int = 16_384,
    seed: int = 42,
    keep: list[str] | None = None,
) -> Mix:
    """Plan a mix of all rows of ``docs``.  Sources take ``weights`` in turn, in code point order
    (null last).  ``keep``: columns to carry (default: the id only; the text is never carried
    unless named).  The number of sources is taken to fit the driver: one row each."""
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    d = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("_row"), F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_order"),
    )
    narrow = text_col not in keep
    if narrow:
        d = pinned(d, "mix-sizes")
    rows = d.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    w = [float(weights[i % len(weights)]) for i in range(len(rows))]
    goal = targets([r["size"] for r in rows], w, share, cap)
    plans = [plan_source(i, r["_source"], r["size"], t, block_words, seed) for i, (r, t) in enumerate(zip(rows, goal))]

    # start of each document in its source's packing: sums within hash buckets, then bucket offsets
    buckets = max(1, -(-sum(r["n"] for r in rows) // BUCKET_DOCS))
    names = spark.createDataFrame([(s.name, s.index) for s in plans], "_name string, _sidx int")
    if len(plans) <= BROADCAST_SOURCES:
        names = F.broadcast(names)
    d = d.join(names, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
    d = d.withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
    sums = d.groupBy("_sidx", "_bucket").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_sidx").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_sidx", "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_sidx", "_bucket").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(offsets, ["_sidx", "_bucket"])
    d = d.select("_row", "_sidx", "_size", (F.col("_off") + F.col("_in")).alias("_start"))
    if narrow:
        d = layout = pinned(d, "mix-layout")
    else:  # texts go through the windows once more rather than through the shared folder
        layout = pinned(d.select("_sidx", "_size", "_start"), "mix-layout")
    return Mix(d, layout, _slots(spark, plans, block_words, shard_slots, seed), plans, block_words)


def _slots(spark, plans: list[SourcePlan], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial source counts of each shard, running totals of each source over the shards,
    then one row for each slot.  Draws beyond a source's slots are void; slots that no draw has
    reached follow in extra shards, so every source's slots come exactly once."""
    live = [p for p in plans if p.slots]
    total = sum(p.slots for p in live)
    shards = -(-total // shard_slots)
    by_index = {p.index: p for p in live}
    quota = {p.index: p.slots for p in live}
    odds = np.array([p.slots for p in live], dtype=float) / max(total, 1)

    def draw(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                n = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(n, odds)
                yield pd.DataFrame({"shard": shard, "sidx": [p.index for p in live], "n": counts})

    drawn = spark.range(shards).mapInPandas(lean(draw), "shard long, sidx int, n long")
    ends = spark.createDataFrame([(shards, p.index, p.slots) for p in live], "shard long, sidx int, n long")
    upto = Window.partitionBy("sidx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.unionByName(ends).withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))

    def expand(batches):
        for pdf in batches:
            for shard, i, n, first in pdf[["shard", "sidx", "n", "first"]].itertuples(index=False):
                p, end = by_index[i], min(first + n, quota[i])
                for lo in range(first, end, 65_536):
                    j = np.arange(lo, min(lo + 65_536, end))
                    block = np.empty(len(j), dtype=np.int64)
                    for e in range(j[0] // p.blocks, j[-1] // p.blocks + 1):
                        own = j // p.blocks == e
                        block[own] = Permutation(p.blocks, seed, i, e)(j[own] % p.blocks)
                    yield pd.DataFrame(
                        {
                            "shard": shard + ((j - first) // shard_slots if shard == shards else 0),
                            "sidx": np.int32(i), "slot": j, "pass": j // p.blocks, "block": block,
                            "slot_words": np.where(j == p.slots - 1, p.last_words, block_words),
                        }
                    )

    schema = "shard long, sidx int, slot long, pass long, block long, slot_words long"
    return runs.where("n > 0").mapInPandas(lean(expand), schema)


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken."""
    m = mix(docs)
    taken = m.taken().groupBy(F.col("sidx").alias("_sidx"), F.col("doc_start").alias("_start"))
    taken = taken.agg(F.sum("words").alias("taken"))
    sources = m.source_table()
    if len(m.sources) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    sized = m.documents.where("_size > 0").join(taken.hint("merge"), ["_sidx", "_start"], "left")
    empty = m.documents.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = sized.unionByName(empty).join(sources, "_sidx")
    return out.select(
        "_row.doc_id", F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source_name").alias("source"),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: one row for each unbroken run of words that a
    pass takes of a document, with the text of the run as it stands in the document (the whole
    text if all of it is taken)."""
    m = mix(docs, text_col=text_col, keep=docs.columns, **options)
    uses = m.taken().groupBy(F.col("sidx").alias("_sidx"), F.col("doc_start").alias("_start"))
    uses = uses.agg(F.collect_list(F.struct("pass", "first_word", "words")).alias("_uses"))  # two for each block at most
    joined = m.documents.where("_size > 0").join(uses.hint("merge"), ["_sidx", "_start"])
    names, word = docs.columns, re.compile(WORD)
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def parts(text: str, size: int, uses: list[dict]) -> list[str]:
        runs: list[list[int]] = []
        for u in sorted((u["pass"], u["first_word"], u["words"]) for u in uses):
            if runs and runs[-1][0] == u[0] and runs[-1][2] == u[1]:
                runs[-1][2] += u[2]
            else:
                runs.append([u[0], u[1], u[1] + u[2]])
        if all((a, b) == (0, size) for _, a, b in runs):
            return [text] * len(runs)
        at: dict[int, tuple[int, int]] = {}  # spans of the words that begin or end a run
        wanted = {k for _, a, b in runs for k in (a, b - 1)}
        for k, x in enumerate(word.finditer(text)):
            if k in wanted:
                at[k] = x.span()
        return [text if (a, b) == (0, size) else text[at[a][0] : at[b - 1][1]] for _, a, b in runs]

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_CUT):
                b = batch.slice(lo, ROWS_CUT)
                source, texts = [], []
                for r, (size, uses) in enumerate(zip(b["_size"].to_pylist(), b["_uses"])):
                    own = parts(b.column(text_at)[r].as_py(), size, uses.as_py())
                    source += [r] * len(own)
                    texts += own
                at = pa.array(source, pa.int64())
                columns = [c.take(at) for c in b.columns[: len(names)]]
                columns[text_at] = pa.array(texts, b.schema.types[text_at])
                if chars_at is not None:
                    columns[chars_at] = pa.array([len(t) for t in texts]).cast(b.schema.types[chars_at])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = [F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(names)]
    return joined.select(*columns, "_size", "_uses").mapInArrow(lean(cut), T.StructType(docs.schema.fields))
