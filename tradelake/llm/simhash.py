"""Near-duplicates by SimHash, compared exactly in tiles.

Fingerprints within ``radius`` bits agree in at least (blocks - radius) of ``blocks`` equal bit
blocks, so every link lies inside a group of fingerprints that share one choice of blocks.  Each
group is compared exactly: fingerprints are ordered by population count and cut into tiles; a
pair of tiles whose population counts are further apart than the radius is skipped, the others
are compared with numpy exclusive-or and bit counts.  A group above ``tile`` fingerprints is
split by (population count, hash) into tiles that meet pairwise in tasks of their own, so no
task holds a whole hot group.  Copies are folded into one fingerprint before anything is dealt
out.  Each comparison returns a spanning forest of its links, never all pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
null doc_id keeps its row (component_id is the smallest non-null id reachable, null if none);
repeated rows each get a row; empty tables give no rows; only id and text are read, other columns
pass through ``drop_near_duplicates``; a very long text is hashed in pieces of about a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, pinned
from .components import connected_components

TILE = 2048
SUBTILE = 256
PIECE = 1 << 20  # bytes of a text hashed together


def hash_pieces(text: str | None, words: int, seed: int, size: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``words`` words, ASCII letters lower-cased, joined by one space, for one
    piece of the text after the other; fewer words: of all of them."""
    held: list[bytes] = []
    some = False
    for piece in pieces((text or "").encode("utf-8", "replace"), size):
        parts = held + piece.lower().split()
        held = parts[max(0, len(parts) - words + 1) :]
        n = len(parts) - words + 1
        if n < 1:
            continue
        some, line = True, b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        cut = map(slice, starts[:n].tolist(), (ends[words - 1 :] - 1).tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cut), repeat(seed)), dtype=np.uint64, count=n)
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], dtype=np.uint64)


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of the hashes (arrays of them); no hashes: 0."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        n += len(h)
        for lo in range(0, len(h), 65_536):
            part = np.ascontiguousarray(h[lo : lo + 65_536])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """doc_id, row_hash (of id and text), fp (64 bits as a signed long)."""
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text")
    )

    def compute(batches):
        for b in batches:
            fp = [fingerprint(hash_pieces(t.as_py(), words, seed)) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row_hash"], pa.array(fp, pa.int64())], names=["doc_id", "row_hash", "fp"])

    kind = dict(d.dtypes)["doc_id"]
    return pinned(d.mapInArrow(lean(compute), f"doc_id {kind}, row_hash long, fp long"), "fingerprints")


def block_masks(radius: int) -> list[int]:
    """For every choice of blocks that fingerprints within ``radius`` bits may agree in, the mask
    of its bits: radius + 2 blocks, of which two agree."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [own[a] | own[b] for a, b in combinations(range(n), 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within ``a`` (b is None) or between ``a`` and ``b``: (node, root)."""
    nodes = a if b is None else np.concatenate([a, b])
    pops = np.bitwise_count(nodes)
    side = np.zeros(len(nodes), dtype=bool)
    side[len(a) :] = True
    order = np.lexsort((side, pops))
    v, p, side = nodes[order], pops[order].astype(np.int16), side[order]
    found_i, found_j = [], []
    for i in range(0, len(v), SUBTILE):
        vi, last = v[i : i + SUBTILE], p[min(i + SUBTILE, len(v)) - 1]
        for j in range(i, len(v), SUBTILE):
            if p[j] - last > radius:  # all later tiles are further away still
                break
            near = np.bitwise_count(vi[:, None] ^ v[j : j + SUBTILE][None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            keep = (x < y) if b is None else (x < y) & (side[x] != side[y])
            found_i.append(x[keep])
            found_j.append(y[keep])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    label = np.arange(len(v))
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (old == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(v)))
    return v[moved], v[label[moved]]


def links(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``fps``: distinct fp.  u, v: a spanning forest of the links in every group or tile pair."""
    masks = F.array(*[F.lit(m) for m in block_masks(radius)])
    keyed = fps.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(masks).alias("choice", "mask"))
    keyed = keyed.select("fp", "pop", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = keyed.groupBy("choice", "key", "pop").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("choice", "key").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"),  # 65 at most
    )
    rows = keyed.join(groups.where("total > 1"), ["choice", "key"])

    # a small group is one unit; in a hot one a tile meets each tile within the radius in a unit
    at = F.struct(F.col("pop").alias("p"), F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("pop")]).cast("int").alias("t"))

    def meet(p: Column) -> Column:
        other = F.transform(
            F.sequence(F.lit(0), F.col("tiles")[p] - 1), lambda t: F.struct(p.alias("p"), t.cast("int").alias("t"))
        )
        return F.transform(
            other,
            lambda o: F.struct(
                F.least(at, o).alias("first"), F.greatest(at, o).alias("second"), (at > o).cast("int").alias("side")
            ),
        )

    around = F.filter(
        F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.map_contains_key(F.col("tiles"), p)
    )
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("t"))
    whole = F.array(F.struct(none.alias("first"), none.alias("second"), F.lit(0).alias("side")))
    units = F.when(F.col("total") <= tile, whole).otherwise(F.flatten(F.transform(around, meet)))
    dealt = rows.select("choice", "key", "fp", F.explode(units).alias("unit"))
    gathered = dealt.groupBy("choice", "key", "unit.first", "unit.second").agg(
        F.collect_list(F.when(F.col("unit.side") == 0, F.col("fp"))).alias("a"),
        F.collect_list(F.when(F.col("unit.side") == 1, F.col("fp"))).alias("b"),
    )  # two tiles at most
    gathered = gathered.select("a", F.when(F.col("first") != F.col("second"), F.col("b")).alias("b"))
    gathered = gathered.where("size(a) > 0 and (b is null and size(a) > 1 or size(b) > 0)")

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch["a"], batch["b"]):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if b.is_valid:
                    u, v = tile_links(x, b.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
                elif len(x) == 2:
                    near = (int(x[0]) ^ int(x[1])).bit_count() <= radius
                    u, v = (x[:1], x[1:]) if near else (x[:0], x[:0])
                else:
                    u, v = tile_links(x, None, radius)
                us.append(u)
                vs.append(v)
            if us:
                both = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
                yield pa.RecordBatch.from_arrays(both, names=["u", "v"])

    return gathered.mapInArrow(lean(compare), "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """Per row of ``docs``: doc_id, row_hash, fp, root (a fingerprint that names the group),
    component_id."""
    fps = fingerprints(docs, id_col, text_col, words, seed)
    reps = pinned(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(reps.select("fp"), radius))
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    return fps.join(named, "fp").select("doc_id", "row_hash", "fp", "root", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    g = simhash_groups(docs)
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest id stays (null ids
    last; among equal ids the smaller row hash; among fully repeated rows any one)."""
    g = simhash_groups(docs, id_col, text_col, **options)
    best = g.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("k"))
    best = best.select(F.col("k.row_hash").alias("_row_hash"), F.col("k.doc_id").alias("_kept_id"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_all")  # columns of any names
    d = docs.select(row, F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("_id"))
    same = (F.col("_row") == F.col("_row_hash")) & F.col("_id").eqNullSafe(F.col("_kept_id"))
    kept = d.join(best, same, "left_semi").dropDuplicates(["_row", "_id"])
    return kept.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
