"""Exact Jaccard join of documents' word shingles by PartEnum signatures.

Two sets link when ``100 * intersection >= threshold * union``.  Then their symmetric difference is
at most ``(100 - t) / (100 + t)`` of the sum of their sizes, and their sizes lie in the same or in
neighbouring size bands (a band ends at 100/t times its begin).  Every set therefore makes the
signatures of its own band and of the next; inside a band all sets use one bound k on the
difference.  The feature domain (shingle hashes) is dealt to ``ceil((k+1)/2)`` partitions, of which
one at least differs in at most one element; each partition has three parts, and the signatures are
its three subsets of two parts: the one that leaves out the differing element is equal in both sets.
So sets that link always share a signature.

On Spark: equal sets fold into one node.  Signature rows are dealt out by signature, sorted, and read
as a stream that drops signatures of one node.  Inside a signature, nodes are compared by parity
sketches: bit b is the parity of the elements that hash to b, so two sketches differ in no more bits
than the sets in elements, and pairs beyond the bound are no links.  Three rounds verify candidates
exactly by intersection, and links join components: each signature's first node beside the others;
then, in signatures that still hold several components, a spanning forest of the nearest pairs
between components; at last all other pairs between components.  So no link between components is
lost; pairs inside one component are connected already and not needed.  Sketches travel only with
the pairs of the first round and with signatures that are still open.  A large signature is cut into
tiles that meet two by two.

A subset of parts without elements is equal for all sets that lack them.  Such a signature is joined
with each signature of a second, independent dealing (similar sets share one of these too).

Defined results: null, empty and blank texts have the empty set and link with nothing (their
component is their own id); fewer words than a shingle make one shingle of all words; a null id keeps
its row (component_id: the smallest id reachable, null if there is none); repeated rows each get a
row; empty tables give no rows; only id and text are read, so other columns may have any name; a very
long text is hashed piece by piece (8 bytes a word are held, and one long is kept for each shingle).
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, pieces, pinned
from .components import connected_components

SHINGLE_WORDS = 4
THRESHOLD = 85
PARTS = 3  # of a partition; a signature leaves one out
PIECE = 1 << 20
TILE = 1536  # nodes of a signature that meet at a time
SKETCH_WORDS = 8  # of 64 bits, at least
MOST_WORDS = 32  # larger sets are told apart less well, never wrongly
COMPARED = 2_000_000  # sketch words compared together
FAR = np.int32(1 << 30)
FEW = 16  # nodes of a unit that are compared one by one
MOST_KEPT = 4096  # partitions of a band whose places a worker keeps
SECOND_DEALING_UP_TO = 2048  # signatures of a set
REMEMBERED = 100_000
ROWS_OUT = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)
VALUE_SEED = np.uint64(0xD6E8FEB86659FD93)
SKETCH_SEED = np.uint64(0xA0761D6478BD642F)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word, ASCII letters lower-cased."""
    out = []
    for piece in pieces(data, PIECE):
        parts = piece.lower().split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_set(data: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words: one of them all."""
    w = word_hashes(data)
    if not len(w):
        return w
    width = min(words, len(w))
    n = len(w) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):  # words are hashed well already: a polynomial of them, scrambled once
            total *= ODD
            total += w[i : i + n]
    return np.unique(mix64(total))


@lru_cache(maxsize=8)
def band_ends(threshold: int, up_to: int) -> tuple[int, ...]:
    """Largest size of each band, until ``up_to`` lies in one."""
    ends, low = [], 1
    while not ends or ends[-1] < up_to:
        ends.append(low * 100 // threshold)
        low = ends[-1] + 1
    return tuple(ends)


def band_difference(end: int, threshold: int) -> int:
    """Bound on the symmetric difference of two linked sets of at most ``end`` elements."""
    return 2 * end * (100 - threshold) // (100 + threshold)


def _places(band: int, k: int, dealing: int, parts: int) -> tuple[np.uint64, np.ndarray]:
    """Seed of a band's dealing, and a number for each cell."""
    partitions = (k + 2) // 2
    with np.errstate(over="ignore"):
        tag = mix64(np.array([(dealing << 32) + band], dtype=np.uint64) * ODD)[0]
        return tag, mix64(np.arange(partitions * parts, dtype=np.uint64).reshape(partitions, parts) + tag)


_kept_places = lru_cache(maxsize=256)(_places)


def _others(x: np.ndarray) -> np.ndarray:
    """For each part of a partition, the sum of the other parts."""
    total = x[:, 0].copy()
    for i in range(1, x.shape[1]):
        total += x[:, i]
    return total[:, None] - x


def band_signatures(
    h: np.ndarray, band: int, k: int, dealing: int, parts: int = PARTS, values: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set in a band, and whether the subset of parts was empty.  ``values``: of the
    elements, where they are known."""
    partitions = (k + 2) // 2
    cells = partitions * parts
    # The same for all sets of a band; those of very large sets are not kept.
    tag, place = (_kept_places if partitions <= MOST_KEPT else _places)(band, k, dealing, parts)
    values = mix64(h ^ VALUE_SEED) if values is None else values
    with np.errstate(over="ignore"):
        high = mix64(h ^ tag) >> np.uint64(32)
        cell = ((high * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(cells, dtype=np.uint64)
        np.add.at(sums, cell, values)
        count = np.bincount(cell, minlength=cells).reshape(partitions, parts)
        rest = _others(sums.reshape(partitions, parts))
        return mix64(rest + place).ravel(), (_others(count) == 0).ravel()


def signatures(h: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """All signatures of a set; none in bands whose linked sets are equal (they are one node)."""
    out = []
    ends = band_ends(threshold, 1 << max(4, len(h).bit_length()))
    own = bisect_left(ends, len(h))
    ends = ends if own + 1 < len(ends) else band_ends(threshold, ends[-1] + 1)
    values = mix64(h ^ VALUE_SEED)
    for band in (own, own + 1):
        k = band_difference(ends[band], threshold)
        if k == 0:
            continue
        sig, empty = band_signatures(h, band, k, 0, values=values)
        if empty.any() and len(sig) <= SECOND_DEALING_UP_TO:
            second, _ = band_signatures(h, band, k, 1, parts=2, values=values)
            with np.errstate(over="ignore"):
                joined = mix64(sig[empty][:, None] * ODD + second[None, :]).ravel()
            sig = np.concatenate([sig[~empty], joined])
        out.append(sig)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def node_of(h: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return xxhash.xxh3_128_digest(np.ascontiguousarray(h).data)


def as_key(node: bytes) -> int:
    """First half of a node, as a signed long: the key of candidates.  Where two nodes share it, both
    are verified."""
    return int.from_bytes(node[:8], "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2 (128-bit hash of the text), text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        text.cast("binary").alias("text"),
    )


def node_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: doc_id, t1, t2, n (set size), node (128 bits), key."""
    d = _texts(docs, id_col, text_col)

    def compute(batches):
        for b in batches:
            sizes, nodes = [], []
            for t in b["text"]:
                h = shingle_set(t.as_py(), words)
                sizes.append(len(h))
                nodes.append(node_of(h))
            new = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(map(as_key, nodes), pa.int64())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t1"], b["t2"], *new], names=["doc_id", "t1", "t2", "n", "node", "key"])

    kind = dict(d.dtypes)["doc_id"]
    return pinned(d.mapInArrow(lean(compute), f"doc_id {kind}, t1 long, t2 long, n long, node binary, key long"), "ngram-nodes")


def signature_rows(docs: DataFrame, text_col: str, words: int, threshold: int) -> DataFrame:
    """sig, key: signatures of every set.  A task skips a set it has just seen."""
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def compute(batches):
        seen: set[bytes] = set()
        sigs, keys, held = [], [], 0
        for b in batches:
            for t in b["text"]:
                h = shingle_set(t.as_py(), words)
                node = node_of(h)
                if not len(h) or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                sig = signatures(h, threshold)
                sigs.append(sig.view(np.int64))
                keys.append(np.full(len(sig), as_key(node), dtype=np.int64))
                held += len(sig)
                if held >= ROWS_OUT:
                    yield _rows(sig=sigs, key=keys)
                    sigs, keys, held = [], [], 0
        if held:
            yield _rows(sig=sigs, key=keys)

    return d.mapInArrow(lean(compute), "sig long, key long")


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in columns.values()], names=list(columns))


def stars(rows: DataFrame) -> DataFrame:
    """sig, first, key: every other node of a signature beside its first; lone nodes give nothing.  Rows
    are sorted by one column (Spark sorts a long by its digits, several columns by comparing) and a
    signature's first is the least of its nodes in the batch where it begins, so that the signatures of
    a cluster mostly share theirs.  A node of which a signature has several rows comes once a batch."""
    ordered = rows.repartition("sig").sortWithinPartitions("sig")

    def stream(batches):
        sig0 = first0 = None  # of the last row of the batch before
        for b in batches:
            sig, key = b["sig"].to_numpy(), b["key"].to_numpy()
            if not len(sig):
                continue
            begins = np.empty(len(sig), dtype=bool)
            begins[0] = True
            begins[1:] = sig[1:] != sig[:-1]
            least = np.minimum.reduceat(key, np.flatnonzero(begins))
            if sig0 is not None and sig[0] == sig0:
                least[0] = first0
            unit = np.cumsum(begins) - 1
            sig0, first0 = sig[-1], least[-1]
            keep = np.flatnonzero(key != least[unit])
            if not len(keep):
                continue
            keep = keep[np.lexsort((key[keep], unit[keep]))]
            again = np.zeros(len(keep), dtype=bool)
            again[1:] = (unit[keep][1:] == unit[keep][:-1]) & (key[keep][1:] == key[keep][:-1])
            keep = keep[~again]
            yield _rows(sig=[sig[keep]], first=[least[unit[keep]]], key=[key[keep]])

    return ordered.mapInArrow(lean(stream), "sig long, first long, key long")


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the elements by hash; a power of two of words, about a bit for each element up to
    MOST_WORDS."""
    words = min(MOST_WORDS, max(SKETCH_WORDS, 1 << max(0, (len(h) - 1) // 64).bit_length()))
    bit = mix64(h ^ SKETCH_SEED) & np.uint64(64 * words - 1)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer words."""
    while len(s) > words:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def sets_of(docs: DataFrame, nodes: DataFrame, keys: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """key, node, n, sketch, shingles of the nodes whose key is in ``keys``, each read from one of its
    rows."""
    wanted = nodes.join(keys.select("key").distinct(), "key", "left_semi")
    one = wanted.groupBy("node").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("x")).select("x.*")
    d = _texts(docs, id_col, text_col)
    one = one.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    same = (d["t1"] == one["_t1"]) & (d["t2"] == one["_t2"]) & d["doc_id"].eqNullSafe(one["_id"])
    texts = d.join(one, same, "left_semi").select("text")

    def compute(batches):
        for b in batches:
            for t in b["text"]:
                h = shingle_set(t.as_py(), words)
                node = node_of(h)
                row = {"key": [as_key(node)], "node": [node], "n": [len(h)], "sketch": [sketch(h).tobytes()]}
                yield pa.RecordBatch.from_pydict(row | {"shingles": pa.array([h.view(np.int64)], pa.list_(pa.int64()))})

    sets = texts.mapInArrow(lean(compute), "key long, node binary, n long, sketch binary, shingles array<long>")
    return pinned(sets.dropDuplicates(["node"]), "ngram-sets")


def near_pairs(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """a, b: nodes of the key pairs (k1, k2) whose sketches do not tell them apart."""
    left = sketches.toDF("k1", "a", "n1", "s1")
    right = sketches.toDF("k2", "b", "n2", "s2")
    both = pairs.join(left, "k1").join(right, "k2").select("a", "n1", "s1", "b", "n2", "s2")

    def near(batches):
        for batch in batches:
            kept = [[], []]
            for a, n1, s1, b, n2, s2 in zip(*[c.to_pylist() for c in batch.columns]):
                for x, y in few_pairs([(False, a, n1, s1, a), (False, b, n2, s2, b)], threshold, True):
                    kept[0].append(x)
                    kept[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()) for k in kept], names=["a", "b"])

    return both.mapInArrow(lean(near), "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """u, v: nodes of the candidate pairs (a, b) that link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - F.col("shared")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", shared.alias("shared"))
    return both.where(100 * F.col("shared") >= threshold * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def units(members: DataFrame, tile: int) -> DataFrame:
    """``members`` (sig, node, ...) dealt to units (sig, i, j): a signature's nodes are cut into tiles,
    each tile meets itself and every other one.  ``side``: the row's tile is j, not i."""
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    rows = members.join(sizes.select("sig", tiles.alias("tiles")), "sig")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.col("own") > F.col("other")})
    return rows.drop("tiles", "own", "other")


def distances(sketches: list[bytes], n: np.ndarray, apart: np.ndarray, threshold: int) -> np.ndarray:
    """Bits in which sketches differ, FAR where the sets cannot link or are not ``apart`` (a number for
    each: pairs of equal numbers are left out, negative numbers are in no pair with one another's)."""
    arrays = [np.frombuffer(s, dtype=np.uint64) for s in sketches]
    words = min(map(len, arrays))
    m = np.stack([folded(a, words) for a in arrays])
    out = np.full((len(m), len(m)), FAR, dtype=np.int32)
    step = max(1, COMPARED // (len(m) * words))
    for lo in range(0, len(m), step):
        hi = min(lo + step, len(m))
        d = np.bitwise_count(m[lo:hi, None, :] ^ m[None, :, :]).sum(axis=2, dtype=np.int32)
        near = (100 + threshold) * d.astype(np.int64) <= (100 - threshold) * (n[lo:hi, None] + n[None, :])
        out[lo:hi] = np.where(near & (apart[lo:hi, None] != apart[None, :]), d, FAR)
    np.fill_diagonal(out, FAR)
    return out


def nearest_forest(d: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that are not FAR, near ones first: every component takes its
    nearest pair to another one, until none is left.  ``label``: components to begin with."""
    label, us, vs = np.arange(len(d)) if label is None else label.copy(), [], []
    while True:
        other = np.where(label[:, None] != label[None, :], d, FAR)
        to = other.argmin(axis=1)
        best = other[np.arange(len(d)), to]
        order = np.lexsort((np.arange(len(d)), best, label))
        first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
        u = first[best[first] < FAR]
        if not len(u):
            return np.concatenate(us or [u]), np.concatenate(vs or [u])
        us.append(u)
        vs.append(to[u])
        name = np.arange(label.max() + 1)  # of each component, the least it is joined to
        while True:
            low = np.minimum(name[label[u]], name[label[to[u]]])
            new = name.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[to[u]], low)
            new = new[new]
            if (new == name).all():
                break
            name = new
        label = name[label]


def few_pairs(rows: list[tuple], threshold: int, every: bool) -> list[tuple[bytes, bytes]]:
    """Candidates of a unit of a few nodes, by sketches as whole numbers: pair by pair instead of in
    matrices, which cost more than they save here.  ``rows``: side, node, n, sketch, root."""
    bits = 8 * min(len(r[3]) for r in rows)
    numbers = []
    for r in rows:
        x, own = int.from_bytes(r[3], "little"), 8 * len(r[3])
        while own > bits:
            own //= 2
            x = (x >> own) ^ (x & ((1 << own) - 1))
        numbers.append(x)
    across = any(r[0] for r in rows)
    found = []
    for j in range(1, len(rows)):
        for i in range(j):
            if across and rows[i][0] == rows[j][0] or rows[i][4] == rows[j][4]:
                continue
            d = (numbers[i] ^ numbers[j]).bit_count()
            if (100 + threshold) * d <= (100 - threshold) * (rows[i][2] + rows[j][2]):
                found.append((d, i, j))
    if not every and len(rows) > 2:
        label, kept = [r[4] for r in rows], []
        for d, i, j in sorted(found):
            if label[i] != label[j]:
                kept.append((d, i, j))
                label = [label[i] if x == label[j] else x for x in label]
        found = kept
    return [(min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])) for _, i, j in found]


def candidates(dealt: DataFrame, threshold: int, every: bool) -> DataFrame:
    """a, b: candidate pairs of nodes with different roots in each unit: a spanning forest, or
    ``every`` one."""
    rows = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    rows = rows.select("sig", "i", "j", "side", "node", "n", "sketch", "root")

    def unit_pairs(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) <= FEW:
            return few_pairs(rows, threshold, every)
        side, node, n, sketches, root = zip(*rows)
        n, side = np.array(n), np.array(side)
        number: dict[bytes, int] = {}
        roots = np.array([number.setdefault(r, len(number)) for r in root])
        d = distances(sketches, n, roots, threshold)
        if side.any():  # two tiles: only pairs across
            d[side[:, None] == side[None, :]] = FAR
        u, v = np.nonzero(np.triu(d < FAR)) if every else nearest_forest(d, roots)
        return [(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(u, v)]

    def find(batches):
        unit, held = None, []
        pairs: set[tuple[bytes, bytes]] = set()  # most come from many signatures

        def flush():
            columns = [pa.array(x, pa.binary()) for x in zip(*pairs)]
            pairs.clear()
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            for sig, i, j, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (sig, i, j) != unit:
                    if len(held) > 1:
                        pairs.update(unit_pairs(held))
                    unit, held = (sig, i, j), []
                held.append(row)
            if len(pairs) > ROWS_OUT:
                yield flush()
        if len(held) > 1:
            pairs.update(unit_pairs(held))
        if pairs:
            yield flush()

    return rows.mapInArrow(lean(find), "a binary, b binary").distinct()


def jaccard_links(
    docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, threshold: int, tile: int = TILE
) -> DataFrame:
    """node, root: components of the sets that link (see `connected_components`)."""
    star = pinned(stars(signature_rows(docs, text_col, words, threshold)), "ngram-stars")
    keyed = star.select("sig", "key").union(star.select("sig", "first").distinct())
    sets = sets_of(docs, nodes, keyed, id_col, text_col, words)
    sketches = sets.select("node", "n", "sketch")
    firsts = star.select(F.least("first", "key").alias("k1"), F.greatest("first", "key").alias("k2")).distinct()
    tried = pinned(near_pairs(firsts, sets.select("key", "node", "n", "sketch"), threshold), "ngram-pairs")
    found = pinned(verified(tried, sets, threshold), "ngram-links")
    for every in (False, True):
        roots = connected_components(found)
        root_of = sets.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        tagged = keyed.join(root_of, "key").drop("key")
        several = tagged.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
        still = tagged.join(several.select("sig"), "sig", "left_semi")
        fresh = candidates(units(still, tile).join(sketches, "node"), threshold, every)
        fresh = pinned(fresh.join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        tried = tried.union(fresh)
        found = found.union(pinned(verified(fresh, sets, threshold), "ngram-links"))
    return connected_components(found)


def ngram_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, **options
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, node, component_id."""
    if not 50 < threshold < 100:
        raise ValueError("threshold is a per cent above 50 and below 100")
    nodes = node_table(docs, id_col, text_col, words)
    roots = jaccard_links(docs, nodes, id_col, text_col, words, threshold, **options)
    least = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("node", "component_id")
    out = nodes.where("n > 0").join(named, "node").select("doc_id", "n", "node", "component_id")
    alone = nodes.where("n = 0").select("doc_id", "n", "node", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumnRenamed("n", "n_shingles")


def ngram_digest(docs: DataFrame) -> DataFrame:
    return ngram_groups(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
),
d AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)]) END AS shingles
  FROM w
),
n AS (SELECT shingles, md5(array_to_string(list_sort(shingles), chr(31))) AS node, doc_id, len(shingles) AS size FROM d),
u AS (SELECT node, any_value(shingles) AS shingles, any_value(size) AS size FROM n WHERE size > 0 GROUP BY node),
e AS (SELECT node, size, unnest(shingles) AS s FROM u),
p AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size
  HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
),
r(node, reach) AS (
  SELECT node, node FROM u
  UNION
  SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a
),
l AS (SELECT node, min(doc_id) AS least FROM n WHERE size > 0 GROUP BY node),
c AS (SELECT r.node, min(l.least) AS component_id FROM r JOIN l ON r.reach = l.node GROUP BY r.node)
SELECT n.doc_id, n.size::BIGINT AS n_shingles, CASE WHEN n.size = 0 THEN n.doc_id ELSE c.component_id END AS component_id
FROM n LEFT JOIN c ON n.node = c.node
"""
