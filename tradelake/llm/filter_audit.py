"""Filter interaction audit: what each of five filters does in each of their 120 orders.

A document fails a set of filters, its mask.  Whatever the order, the mask decides all 600 step
outcomes (120 orders x 5 steps), so each mask (with the two label flags) maps to one big integer of
``MEASURES x 600`` fields of 64 bits: a field is 1 where that outcome happens to such a document.
Tasks add these integers up for each part; sums are merged in two rounds (spread by task number,
then whole) and unpacked at the end.  A field counts documents, so it overflows only beyond 2^64 of
them.

Filters, on whole texts: A under 100 words; B fewer than 80 distinct words in 100; C over 10 capital
letters in 100 code points; D any of ``#$%&*|``; E identical to the text of a smaller id.  A to D are
read in the scan (`mapInArrow`, bytes of the text only).  E needs no join of documents: rows are
counted by (128-bit text hash, id, part, flags), then by text, where only the rows of the smallest id
pass; both steps combine before they shuffle, so a text with a third of all rows is no hot group.

Defined results: null text is the empty text (and identical to it); null ``lang`` is part '';
rows with a null id neither fail E nor make others fail; repeated rows count each, and equal ids
are not smaller than each other; a document is good (toxic) if any row of ``labels`` with its id says
so, null labels say nothing; a very long text is held once, as one value of a batch; empty tables
give no rows; other columns are never read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
TOTAL_BYTES = len(MEASURES) * STEPS * FIELD_BYTES
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
EXACT_DUPLICATE = 1 << FILTERS.index("E")
HELD_PARTS = 256  # sums a task holds at a time
MERGE_FAN = 64


def text_mask(data: bytes) -> int:
    """Filters A to D that a text (UTF-8) fails, as bits."""
    words = data.split()  # bytes split at space, tab, LF, VT, FF and CR only
    n = len(words)
    code_points = len(data.decode("utf-8", "replace"))
    capitals = len(data) - len(data.translate(None, UPPER))
    failed = (
        n < 100,
        100 * len(set(words)) < 80 * n,
        100 * capitals > 10 * code_points,
        len(data.translate(None, MARKS)) < len(data),
    )
    return sum(1 << i for i, x in enumerate(failed) if x)


def step_outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """MEASURES x 600 zeros and ones: what happens to a document with this mask at each step."""
    out = np.zeros((len(MEASURES), STEPS), dtype="<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, at = bool(mask & bit), o * len(FILTERS) + s
            removed = fails and not gone
            gone = gone or fails
            out[:, at] = (not gone, removed, fails and not removed, mask == bit, removed and good, removed and toxic)
    return out


def packed_outcomes() -> dict[tuple[int, bool, bool], int]:
    """The big integer of every (mask, good, toxic)."""
    return {
        (m, g, t): int.from_bytes(step_outcomes(m, g, t).tobytes(), "little")
        for m in range(1 << len(FILTERS))
        for g in (False, True)
        for t in (False, True)
    }


def unpack(total: int) -> np.ndarray:
    """MEASURES x 600 counts of a sum of packed outcomes."""
    return np.frombuffer(total.to_bytes(TOTAL_BYTES, "little"), dtype="<u8").reshape(len(MEASURES), STEPS)


def read_texts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, text_hash (128 bits of the text), mask (A to D)."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def scan(batches):
        for b in batches:
            texts = b["text"]
            masks, hashes = [], []
            for i in range(len(texts)):
                data = texts[i].as_py()
                masks.append(text_mask(data))
                hashes.append(xxhash.xxh3_128_digest(data))
            columns = [b["doc_id"], b["part"], pa.array(hashes, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "text_hash", "mask"])

    return d.mapInArrow(lean(scan), f"doc_id {dict(d.dtypes)['doc_id']}, part string, text_hash binary, mask int")


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """part, mask (all five filters), good, toxic, n: documents alike, counted text by text."""
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    alike = ["text_hash", "mask", "part", "good", "toxic"]
    rows = read_texts(docs, id_col, text_col, part_col).join(flags, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by_id = rows.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without_id"),
    )
    # a text has a row for each (part, flags) it comes with
    least = F.min("first.doc_id").over(Window.partitionBy("text_hash"))
    smallest = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    by_text = by_text.withColumn("least", least).withColumn("passing", smallest + F.col("without_id"))
    both = F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(EXACT_DUPLICATE)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    rows = by_text.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return rows.select("part", "x.mask", "good", "toxic", "x.n")


def _held_sums(values, flush_at: int = HELD_PARTS):
    """Sums by part of a stream of (part, integer), passed on whenever ``flush_at`` parts are held."""
    held: dict[str, int] = {}
    for part, value in values:
        held[part] = held.get(part, 0) + value
        if len(held) > flush_at:
            yield from held.items()
            held = {}
    yield from held.items()


def _sum_batches(sums):
    task = TaskContext.get().partitionId()
    for part, total in sums:
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "task": pa.array([task], pa.int32()), "total": [total.to_bytes(TOTAL_BYTES, "little")]}
        )


def packed_sums(counts: DataFrame) -> DataFrame:
    """part, total: the packed sum of each part.  ``counts``: rows of `mask_counts`."""
    schema = "part string, task int, total binary"

    def add(batches):
        table = packed_outcomes()

        def values():
            for b in batches:
                c = b.to_pydict()
                for part, mask, good, toxic, n in zip(c["part"], c["mask"], c["good"], c["toxic"], c["n"]):
                    yield part, n * table[mask, good, toxic]

        yield from _sum_batches(_held_sums(values()))

    def merge(batches):
        values = (
            (part.as_py(), int.from_bytes(total.as_py(), "little")) for b in batches for part, total in zip(b["part"], b["total"])
        )
        yield from _sum_batches(_held_sums(values))

    tasks = counts.select("part", "mask", "good", "toxic", "n").mapInArrow(add, schema)
    spread = tasks.repartition("part", F.pmod("task", F.lit(MERGE_FAN))).mapInArrow(merge, schema)
    # parts of one value lie together: sort, so that each sum is complete when the next part begins
    return spread.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_sorted, "part string, total binary")


def _merge_sorted(batches):
    part, total = None, 0
    for b in batches:
        for p, t in zip(b["part"].to_pylist(), b["total"]):
            if part is not None and p != part:
                yield pa.RecordBatch.from_pydict({"part": [part], "total": [total.to_bytes(TOTAL_BYTES, "little")]})
                total = 0
            part, total = p, total + int.from_bytes(t.as_py(), "little")
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": [part], "total": [total.to_bytes(TOTAL_BYTES, "little")]})


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order and step: see the contract columns in ``schema``."""
    counts = ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))

    def rows(batches):
        letters = np.array([list(o) for o in ORDERS]).ravel()
        names = np.repeat(ORDERS, len(FILTERS))
        steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for b in batches:
            for part, total in zip(b["part"].to_pylist(), b["total"]):
                fields = dict(zip(MEASURES, unpack(int.from_bytes(total.as_py(), "little")).astype(np.int64)))
                shares = {f: int(fields["removed"][letters == f].sum()) for f in FILTERS}
                fields["shapley"] = np.array([shares[f] for f in letters], dtype=np.int64)
                columns = {"part": pa.array([part] * STEPS), "filter_order": pa.array(names), "step": pa.array(steps)}
                yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in fields.items()})

    sums = packed_sums(mask_counts(docs, labels, **columns))
    return sums.mapInArrow(rows, f"part string, filter_order string, step int, {counts}")


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
),
t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 100,
          100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body),
          regexp_matches(body, '[#$%&*|]'),
          coalesce(least < t.doc_id, false)] AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (
  SELECT part, good, toxic, n, filter_order, step, seq[step] AS own, fails[seq[step]] AS failing,
         len(list_filter(seq[1:step - 1], lambda k: fails[k])) > 0 AS gone,
         len(list_filter(fails, lambda z: z)) = 1 AS alone
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
),
c AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failing AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c
"""
