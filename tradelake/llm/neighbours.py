"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded hash sample of the vectors (``sample`` rows), and every vector is
then put into its leaf.  A query walks the tree best bin first: a priority queue holds subtrees by
the distance of their centre, and leaves are visited in the order they come out.  How many leaves
a query visits is calibrated: the true neighbours of ``calibration`` queries are found by a scan of
all rows, and visits are widened until their recall reaches ``recall``.  Neighbouring leaves of few
rows form a bundle: a query's walk is one row, and its vector is sent once to each bundle that holds
leaves it visits, where it is compared with the rows of these leaves.  Queries and rows of a bundle meet
in units of bounded size on both sides, so a crowded leaf spreads over tasks.

Of equal vectors only the k + 1 smallest ids can ever be among a query's k nearest (ties go to the
smaller id), so the others are folded away before indexing, without loss; repeated rows go first.

Defined results: vectors that are null, zero, empty, of another than the most common length, or
that hold null or non-finite components take no part, nor do rows with null id; a row repeated
under one id counts once, and no row with the query's id is its neighbour; fewer candidates than k
give them all; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

BLOCK = 4096  # rows, and queries, that meet in one unit
TILE = 512  # queries of a unit that are compared at a time
WALKS = 256  # queries that a task walks the tree for and hands on at a time


def _rows(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def pair_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision, the same for equal rows wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


class Tree:
    """Hierarchical k-means over unit vectors.  ``children[i]``: node numbers; a leaf has none."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branches: int = 8, seed: int = 7):
        self.centres, self.children, self.leaf = [], [], []
        self.leaves = 0
        self._grow(_unit(x), leaf_rows, branches, np.random.default_rng(seed))
        self.centres = np.array(self.centres)

    def _grow(self, x, leaf_rows, branches, rng) -> int:
        me = len(self.centres)
        self.centres.append(x.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        groups = _kmeans(x, branches, rng) if len(x) > max(leaf_rows, branches) else []
        if len(groups) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(x[g], leaf_rows, branches, rng) for g in groups]
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: the nearest child at each step."""
        node, x = np.zeros(len(x), dtype=np.int64), _unit(x)
        while True:
            inner = [n for n in np.unique(node) if self.children[n]]
            if not inner:
                return np.array(self.leaf)[node]
            for n in inner:
                own, kids = np.flatnonzero(node == n), np.array(self.children[n])
                c = self.centres[kids]
                node[own] = kids[((c * c).sum(axis=1) - 2 * x[own] @ c.T).argmin(axis=1)]

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first."""
        q = q / np.sqrt((q * q).sum())
        far = ((self.centres - q) ** 2).sum(axis=1).tolist()
        out, queue = [], [(0.0, 0)]
        while queue and len(out) < leaves:
            _, n = heapq.heappop(queue)
            if not self.children[n]:
                out.append(self.leaf[n])
                continue
            for k in self.children[n]:
                heapq.heappush(queue, (far[k], k))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
    groups = [np.flatnonzero(near == i) for i in range(k)]
    return [g for g in groups if len(g)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double) of the rows that take part, each (id, vector) once."""
    v = F.col("v")
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("v") == (sizes["n"] if sizes else 0)).distinct()


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_pairs(query_ids, q, ids, x, k, meet=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of each query's k nearest rows, best first, ties to the
    smaller id.  A matrix product finds the candidates, some queries at a time; the exact measure ranks
    them.  ``meet``, if given, is true where a query (by queries' positions) meets a row."""
    query_ids, ids, x_unit, tops = np.asarray(query_ids), np.asarray(ids), _unit(x), []
    for lo in range(0, len(q), TILE):
        some = slice(lo, lo + TILE)
        rough = _unit(q[some]) @ x_unit.T
        rough[query_ids[some, None] == ids[None, :]] = -np.inf
        if meet is not None:
            rough[~meet(some)] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
        qi, xi = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -np.inf))
        qi += lo
        score = np.concatenate([pair_cosines(q[qi[i : i + 65_536]], x[xi[i : i + 65_536]]) for i in range(0, len(qi), 65_536)] or [np.empty(0)])
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        tops.append((qi[rank < k], xi[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*tops)) if tops else (np.empty(0, int), np.empty(0, int), np.empty(0))


def bundles_of(sizes: dict[int, int], leaves: int, rows: int) -> list[int]:
    """Bundle of every leaf: leaves that follow each other in the tree, of at most ``rows`` rows together; a
    larger leaf is a bundle of its own."""
    out, bundle, held = [], 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > rows:
            bundle, held = bundle + 1, 0
        out.append(bundle)
        held += n
    return out


def _scan(rows: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """True neighbours of a bounded set of queries: every batch keeps k for each query."""
    qids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries])

    def scan(batches):
        for pdf in batches:
            if len(pdf):
                ids, leaf = pdf["id"].to_numpy(), pdf["leaf"].to_numpy()
                qi, xi, score = nearest_pairs(qids, q, ids, _rows(pdf["v"]), k)
                yield pd.DataFrame({"query_id": qids[qi], "query_key": qi, "vec_id": ids[xi], "score": score, "leaf": leaf[xi]})

    return _top(rows.mapInPandas(scan, "query_id long, query_key long, vec_id long, score double, leaf int"), k)


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    sample: int = 20_000,
    leaf_rows: int = 1024,
    calibration: int = 200,
    recall: float = 0.95,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest found in ``vectors``.
    Leaves hold about ``leaf_rows`` rows, but at least 16 rows of the sample."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    base = usable(vectors, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("id")
    base = base.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    base = pinned(base, "vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
    fit = base.where(part).limit(2 * sample).toPandas() if n > 1 else base.toPandas()
    if not len(fit):
        fit = base.limit(1).toPandas()
    fit = fit.sort_values("id", kind="stable")
    tree = Tree(_rows(fit["v"]), max(16, int(leaf_rows * len(fit) / n)))
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=shared.value.assign(_rows(pdf["v"])).astype(np.int32))

    index = pinned(base.mapInPandas(place, "id long, v array<double>, leaf int"), "vector-leaves")
    q = usable(queries, id_col, vector_col).withColumn("query_key", F.xxhash64("v"))

    # calibration: leaves that a walk must visit to meet the true neighbours
    own = q.orderBy(F.xxhash64("id", "v")).limit(calibration).toPandas()
    own = [(int(i), np.asarray(v, dtype=np.float64)) for i, v in zip(own["id"], own["v"])]
    if not own:
        return spark.createDataFrame([], out_schema)
    truth = _scan(index, own, k).select("query_key", "leaf").toPandas()
    ranks = []
    for (_, v), (_, found) in zip(own, truth.groupby("query_key")):
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visit(v, tree.leaves))}
        ranks += [order[leaf] for leaf in found["leaf"]]
    visits = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) if ranks else tree.leaves
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one for each leaf

    bundles = bundles_of(sizes, tree.leaves, BLOCK)  # one for each leaf

    def walk(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), WALKS):
                part = pdf.iloc[lo : lo + WALKS]
                groups = []
                for v in part["v"]:
                    x, most = np.asarray(v, dtype=np.float64), visits
                    leaves = shared.value.visit(x, most)
                    while sum(sizes.get(leaf, 0) for leaf in leaves) < 2 * k + 2 and len(leaves) < shared.value.leaves:
                        most *= 2  # too few rows seen: widen
                        leaves = shared.value.visit(x, most)
                    own = {}
                    for leaf in leaves:
                        own.setdefault(bundles[leaf], []).append(leaf)
                    groups.append(own)
                yield part.assign(bundles=[list(g) for g in groups], leaves=[list(g.values()) for g in groups])

    walks = max(1, -(-q.count() // WALKS))  # walking costs time, not bytes
    asked = q.repartition(walks, "id", "query_key").mapInPandas(
        walk, "id long, v array<double>, query_key long, bundles array<int>, leaves array<array<int>>"
    )
    asked = pinned(asked, "visits")  # a row for each query
    place_of = spark.createDataFrame([(leaf, b) for leaf, b in enumerate(bundles)], "leaf int, bundle int")
    index = index.join(F.broadcast(place_of), "leaf")
    counts = index.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("row_blocks"))
    visited = asked.select(F.explode("bundles").alias("bundle")).groupBy("bundle")
    counts = counts.join(visited.agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks")), "bundle")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.join(counts, "bundle").select(
        "bundle", "leaf", "id", "v", F.pmod(F.xxhash64("id", "v"), F.col("row_blocks")).cast("int").alias("rb"), every(F.col("query_blocks")).alias("qb")
    )
    visits_of = asked.select("id", "v", "query_key", F.explode(F.arrays_zip("bundles", "leaves")).alias("b"))
    visits_of = visits_of.select("id", "v", "query_key", F.col("b.bundles").alias("bundle"), F.col("b.leaves").alias("leaves"))
    right = visits_of.join(counts, "bundle").select(
        "bundle", "leaves", "id", "v", "query_key", F.pmod(F.xxhash64("id", "query_key"), F.col("query_blocks")).cast("int").alias("qb"),
        every(F.col("row_blocks")).alias("rb"),
    )

    def compare(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "query_key", "vec_id", "score"]
        if not len(rows) or not len(qs):
            return pd.DataFrame({c: [] for c in cols})
        ids, qid, key = rows["id"].to_numpy(), qs["id"].to_numpy(), qs["query_key"].to_numpy()
        found, at = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        visited = np.array([np.isin(found, leaves) for leaves in qs["leaves"]])  # queries x leaves of the unit
        qi, xi, score = nearest_pairs(qid, _rows(qs["v"]), ids, _rows(rows["v"]), k, lambda some: visited[some][:, at])
        return pd.DataFrame({"query_id": qid[qi], "query_key": key[qi], "vec_id": ids[xi], "score": score})

    unit = ["bundle", "rb", "qb"]
    met = left.groupBy(*unit).cogroup(right.groupBy(*unit))
    scored = met.applyInPandas(compare, "query_id long, query_key long, vec_id long, score double")
    return _top(scored, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbour_digest(vectors: DataFrame) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50, against all rows."""
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))
