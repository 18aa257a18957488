"""Approximate nearest neighbours by inner product: a hierarchical k-means tree.

The tree is fitted to a bounded sample (``SAMPLE_ROWS``); every row is assigned
to a leaf.  Largest inner product becomes nearest neighbour by one more
coordinate that lifts all vectors to the largest norm.  A query walks the tree
best bin first, through a priority queue of branches by distance, and stops
after a number of leaves; sampled queries, compared with brute force over all
rows, widen that number until they reach ``RECALL`` of their exact neighbours.

The walk is searched in rounds, each ``WIDEN`` times as wide as what was visited
before it.  A query's k-th best score so far spares it the later leaves whose ball
(centre, and the distance of its furthest row) cannot hold a row that scores as much,
and leaves return only rows that score as much; that loses nothing, and a query's
returned rows grow with the logarithm of the leaves it visits.

Queries meet a leaf in blocks: a leaf's rows and its queries are salted into
groups of about ``GROUP_ROWS``, so neither a hot leaf nor a popular one is a
single task.  Scores are double-precision inner products of the original
vectors; ties go to the smaller vec_id.

Defined results: vectors that are null, zero, or hold nulls or non-finite
components take no part, nor do vectors of another length than the commonest
(ties: the longer); rows with the same vec_id count once (the smallest vector);
fewer candidates than k give them all.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skupulse.llm.common import cut, hash_share

SAMPLE_ROWS = 20_000
LEAF_ROWS = 200          # rows per leaf aimed at
MAX_LEAVES = 2_000       # the tree is broadcast: its size is bounded
BRANCHES = 8
CALIBRATION = 64         # queries whose exact neighbours set the slack
RECALL = 0.97
FIRST_LEAVES = 2         # leaves of the first round, whose scores bound what later ones may add
WIDEN = 4                # each round goes on to so many times the leaves visited before
GROUP_ROWS = 4_096


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec (array<float>) of the rows that take part, one per id."""
    vec = F.col("embedding").cast("array<double>")
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
            .where("vec_id is not null and vec is not null and size(vec) > 0")
            .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .where(F.exists("vec", lambda x: x != 0)))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if sizes:
        rows = rows.where(F.size("vec") == sizes[0].n)
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


class Tree:
    """Centres of a hierarchical k-means tree over lifted vectors."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.centres: list[np.ndarray] = []     # per inner node: its children's centres
        self.children: list[list[int]] = []     # child node, or ~leaf
        self.leaf_centres: list[np.ndarray] = []
        self.least = max(1, len(sample) // max(1, leaves))
        self.random = np.random.default_rng(seed)
        self.root = self._split(sample)
        self.leaf_matrix = np.array(self.leaf_centres)

    def _split(self, rows: np.ndarray) -> int:
        own = self._kmeans(rows) if len(rows) > max(self.least, 1) else None
        if own is None or len(own[0]) < 2:
            self.leaf_centres.append(rows.mean(axis=0))
            return ~(len(self.leaf_centres) - 1)
        node = len(self.centres)
        self.centres.append(own[0])
        self.children.append([])
        self.children[node] = [self._split(rows[own[1] == k]) for k in range(len(own[0]))]
        return node

    def _kmeans(self, rows: np.ndarray):
        k = min(BRANCHES, max(2, -(-len(rows) // self.least)))
        centres = rows[self.random.choice(len(rows), min(k, len(rows)), replace=False)]
        near = None
        for _ in range(8):
            near = nearest(rows, centres)
            used = np.unique(near)
            centres = np.stack([rows[near == j].mean(axis=0) for j in used])
        near = nearest(rows, centres)
        used = np.unique(near)
        return centres[used], np.searchsorted(used, near)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, down the nearest branches."""
        out, todo = np.zeros(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
                continue
            near = nearest(rows[at], self.centres[node])
            todo += [(child, at[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def walk(self, query: np.ndarray):
        """Leaves with their squared distance, best bin first."""
        queue = [(0.0, self.root)]
        while queue:
            far, node = heapq.heappop(queue)
            if node < 0:
                yield ~node, far
                continue
            apart = ((self.centres[node] - query) ** 2).sum(axis=1)
            for d, child in zip(apart.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))

    def visits(self, query: np.ndarray, count: int) -> list[int]:
        """The first ``count`` leaves of the walk."""
        return [leaf for leaf, _ in itertools.islice(self.walk(query), count)]


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None] - 2 * rows @ centres.T).argmin(axis=1)


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate brings each row to squared norm ``top``."""
    return np.hstack([rows, np.sqrt(np.maximum(0.0, top - (rows ** 2).sum(axis=1)))[:, None]])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(query_ids, queries, ids, rows, k: int, least=None):
    """(query, vec_id, score) of the k best rows per query, by exact scores;
    of those only rows that score at least ``least`` (one number per query)."""
    out = ([], [], [])
    for first in range(0, len(query_ids), 256):
        rough = queries[first:first + 256] @ rows.T
        for j, line in enumerate(rough):
            q = first + j
            n = min(k + 1, len(line))  # one more: the query itself may be among them
            edge = np.partition(line, len(line) - n)[len(line) - n]
            at = np.flatnonzero(line >= edge - 1e-9 * max(1.0, abs(edge)))
            at = at[ids[at] != query_ids[q]]
            score = (rows[at] * queries[q]).sum(axis=1)
            top = np.lexsort((ids[at], -score))[:k]
            if least is not None:
                top = top[score[top] >= least[q]]
            out[0].append(np.full(len(top), query_ids[q]))
            out[1].append(ids[at][top])
            out[2].append(score[top])
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]


FOUND = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries, in one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)))

    def run(batches):
        ids, vecs = shared.value
        for batch in batches:
            if batch.num_rows:
                a, b, c = _best(ids, vecs, batch.column("vec_id").to_numpy(), _matrix(batch.column("vec")), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "vec_id", "score"])

    return _top(rows.select("vec_id", "vec").mapInArrow(run, FOUND), k)


def calibrate(tree: Tree, placed: DataFrame, queries, k: int, recall: float = RECALL) -> int:
    """Smallest number of leaves at which the sampled queries reach the recall."""
    exact = (brute_force(placed, queries, k).select("query_id", "vec_id")
             .join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect())
    # centres are compared with the query itself, its lift being nothing
    place = {q: {leaf: i for i, (leaf, _) in enumerate(tree.walk(np.append(v, 0.0)), 1)} for q, v in queries}
    need = sorted(place[r.query_id][r.leaf] for r in exact)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else len(tree.leaf_centres)


def index(rows: DataFrame, total: int, top: float) -> tuple[Tree, DataFrame]:
    """The tree of a sample, and every row with its leaf and its distance from the centre."""
    sample = hash_share(rows, SAMPLE_ROWS, total, "vec_id").limit(2 * SAMPLE_ROWS).orderBy("vec_id").select("vec").toArrow()
    if not sample.num_rows:
        sample = rows.orderBy("vec_id").limit(1).select("vec").toArrow()
    tree = Tree(lifted(_matrix(sample.column("vec")), top), int(min(MAX_LEAVES, max(1, total // LEAF_ROWS))))

    def assign(batches):
        for batch in batches:
            vecs = _matrix(batch.column("vec"))
            leaf = tree.leaf_of(lifted(vecs, top)) if batch.num_rows else np.empty(0, np.int64)
            apart = np.sqrt(((vecs - tree.leaf_matrix[leaf, :-1]) ** 2).sum(axis=1)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(apart)], [*batch.schema.names, "leaf", "apart"])

    return tree, cut(rows.mapInArrow(assign, "vec_id long, vec array<double>, leaf long, apart double"))


def route(tree: Tree, asked: DataFrame, first: int, last: int, radius: np.ndarray) -> DataFrame:
    """(query_id, leaf): places first .. last - 1 of each query's walk, without the
    leaves none of whose rows can score the query's ``least``."""
    def visit(batches):
        for batch in batches:
            ids, leaves = [], []
            least = batch.column("least").to_numpy()
            for i, v in enumerate(_matrix(batch.column("vec")) if batch.num_rows else ()):
                walked = np.array(tree.visits(np.append(v, 0.0), last)[first:], np.int64)
                most = tree.leaf_matrix[walked, :-1] @ v + radius[walked] * np.sqrt(v @ v)
                walked = walked[most + 1e-9 * (1 + np.abs(most)) >= least[i]]
                ids.append(np.full(len(walked), batch.column("query_id")[i].as_py(), np.int64))
                leaves.append(walked)
            empty = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or empty)), pa.array(np.concatenate(leaves or empty))],
                                             ["query_id", "leaf"])

    return cut(asked.mapInArrow(visit, "query_id long, leaf long"))


def meet(placed: DataFrame, asked: DataFrame, visited: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in each leaf that it visits."""
    n_rows = placed.groupBy("leaf").agg(F.count("*").alias("n_rows"))
    n_asked = visited.groupBy("leaf").agg(F.count("*").alias("n_asked"))
    parts = cut(n_rows.join(n_asked, "leaf").select(
        "leaf", F.ceil(F.col("n_rows") / GROUP_ROWS).cast("int").alias("rs"), F.ceil(F.col("n_asked") / GROUP_ROWS).cast("int").alias("qs")))
    parts = F.broadcast(parts)  # one row per leaf, at most about MAX_LEAVES
    salt = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(parts, "leaf").select("leaf", "vec_id", "vec", salt("vec_id", "rs").alias("r"), upto("qs").alias("q"))
    right = (visited.join(parts, "leaf").select("leaf", F.col("query_id"), salt("query_id", "qs").alias("q"), upto("rs").alias("r"))
             .join(asked, "query_id").select("leaf", "r", "q", "query_id", "vec", "least"))

    def score(key, rows_, asked_):
        if not rows_.num_rows or not asked_.num_rows:
            a, b, c = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        else:
            a, b, c = _best(asked_.column("query_id").to_numpy(), _matrix(asked_.column("vec")),
                            rows_.column("vec_id").to_numpy(), _matrix(rows_.column("vec")), k,
                            asked_.column("least").to_numpy())
        return pa.table({"query_id": a, "vec_id": b, "score": c},
                        schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return left.groupBy("leaf", "r", "q").cogroup(right.groupBy("leaf", "r", "q")).applyInArrow(score, FOUND)


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose
    vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = cut(usable(embeddings))
    norm = F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    total, top = rows.agg(F.count("*"), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    tree, placed = index(rows, total, top)
    asked = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec", F.lit(float("-inf")).alias("least"))
    probe = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
    if not probe:
        return spark.createDataFrame([], schema)
    count = calibrate(tree, placed, [(r.query_id, r.vec) for r in probe], k)
    radius = np.zeros(len(tree.leaf_centres))
    for r in placed.groupBy("leaf").agg(F.max("apart").alias("apart")).collect():  # at most about MAX_LEAVES
        radius[r.leaf] = r.apart
    near, begin, end = None, 0, min(FIRST_LEAVES, count)
    while begin < end:
        found = meet(placed, asked, route(tree, asked, begin, end, radius), k)
        near = cut(_top(found if near is None else near.union(found), k).drop("rank"))
        begin, end = end, min(WIDEN * end, count)
        if begin < end:
            bound = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
            asked = cut(asked.join(bound, "query_id", "left")
                        .select("query_id", "vec", F.coalesce("bound", "least").alias("least"))).toDF("query_id", "vec", "least")
    return _top(near, k).select("query_id", "rank", "vec_id", "score")
