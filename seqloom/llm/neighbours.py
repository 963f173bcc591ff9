"""Approximate nearest neighbours: a forest of random-projection trees and one queue over all of them.

The trees are fitted on a bounded sample: a node projects on the difference of two random members and splits at
the median.  Every row is then led to its leaf in every tree.  A query walks all trees through one priority
queue, whose order is the squared distance to the splits that were crossed, until the leaves it has reached
hold enough rows.  The rows of those leaves are its candidates, and their distances are exact.

Queries go to the rows in blocks of bounded size.  A task keeps the best of its rows for each query, so no
leaf, however many rows it has, is gathered anywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import query, stored, table
from seqloom.session import spread_rows

#: Rows the trees are fitted on, and how many of them a leaf may hold.
SAMPLE, LEAF = 1 << 14, 32
TREES = 12
#: A query's leaves hold this share of all rows, rows in several trees counted again; never fewer than LEAST.
SHARE, LEAST = 0.75, 2000
#: Queries in a block, and rows that are compared with them together.
QUERIES_IN_BLOCK, ROWS_TOGETHER = 2048, 2048

Forest = list[list]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as doubles) of the rows that take part: no null, zero or non-finite vectors, no null keys."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(key), x.alias(vector)).filter(
        F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists(vector, lambda v: v != 0.0)
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """Trees of nodes [direction, split, left, right] and leaf numbers, which run through all trees."""
    dice = np.random.default_rng(seed)
    leaves = 0

    def split(rows: np.ndarray):
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(8):
                a, b = sample[dice.choice(rows, 2, replace=False)]
                if (a != b).any():
                    direction = (a - b) / np.linalg.norm(a - b)
                    along = sample[rows] @ direction
                    middle = float(np.median(along))
                    left = along <= middle
                    if not left.all():
                        return [direction, middle, split(rows[left]), split(rows[~left])]
        leaves += 1
        return leaves - 1

    return [split(np.arange(len(sample))) for _ in range(trees)]


def lead(tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    out = np.empty(len(x), np.int32)
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if isinstance(node, int):
            out[rows] = node
        elif len(rows):
            left = x[rows] @ node[0] <= node[1]
            stack += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def reach(forest: Forest, x: np.ndarray, held: np.ndarray, enough: float) -> list[int]:
    """Leaves in the order of one queue over all trees, until they hold ``enough`` rows."""
    queue = [(0.0, i, tree) for i, tree in enumerate(forest)]
    pushed, rows, leaves = len(queue), 0, []
    while queue and rows < enough:
        crossed, _, node = heapq.heappop(queue)
        while not isinstance(node, int):
            side = float(x @ node[0]) - node[1]
            near, far = (node[2], node[3]) if side <= 0 else (node[3], node[2])
            heapq.heappush(queue, (crossed + side * side, pushed, far))
            pushed += 1
            node = near
        leaves.append(node)
        rows += held[node]
    return leaves


def count_leaves(node) -> int:
    return 1 if isinstance(node, int) else count_leaves(node[2]) + count_leaves(node[3])


def nearest_in(
    x: np.ndarray, ids: np.ndarray, leaves: np.ndarray, q: np.ndarray, q_ids: np.ndarray, visits: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, distances, ids): the best k of these rows for each query that has candidates among them.

    ``visits``: queries x leaves.  A fast product picks the rows that can be among the best, and their
    distances are then taken from the differences.
    """
    _, same = np.unique(x, axis=0, return_inverse=True)
    same = same.ravel()
    by = np.lexsort((ids, same))
    by = by[np.append(True, (np.diff(same[by]) != 0) | (np.diff(ids[by]) != 0))] if len(by) else by
    # of rows with one vector only the k + 1 of smallest id can be among any query's best
    runs = same[by]
    keep = by[np.arange(len(by)) - np.searchsorted(runs, runs) <= k]
    x, ids, leaves = x[keep], ids[keep], leaves[keep]
    candidate = np.zeros((len(q), len(x)), bool)
    for t in range(leaves.shape[1]):
        candidate |= visits[:, leaves[:, t]]
    candidate &= q_ids[:, None] != ids[None, :]
    own, theirs = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    squared = own + theirs - 2.0 * (q @ x.T)
    slack = 1e-9 * (own + theirs)
    squared[~candidate] = np.inf
    if squared.shape[1] > k:
        limit = np.partition(squared + slack, k - 1, axis=1)[:, k - 1 : k]
    else:
        limit = np.full((len(q), 1), np.inf)
    close = (squared - slack <= limit) & candidate
    for i in np.flatnonzero(close.any(1)):
        rows = np.flatnonzero(close[i])
        exact = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[rows], exact))[:k]
        yield i, exact[best], ids[rows][best]


def fit(vectors: DataFrame, key: str, vector: str, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 7):
    """The forest, fitted on the ``sample`` rows whose keys have the smallest hashes, and the vectors' length."""
    drawn = vectors.orderBy(F.xxhash64(key), key, vector).select(vector).limit(sample).toArrow()  # at most ``sample`` rows
    lengths = drawn.column(0).combine_chunks().value_lengths() if drawn.num_rows else []
    if not len(lengths):
        return [], 0
    sizes, counts = np.unique(lengths.to_numpy(), return_counts=True)
    length = int(sizes[np.argmax(counts)])
    x = matrix(drawn.column(0).combine_chunks().filter(pa.array(lengths.to_numpy() == length)))
    return grow(x, trees, leaf, seed), length


def index(vectors: DataFrame, forest: Forest, key: str, vector: str) -> DataFrame:
    """(key, vector, leaves): every row with its leaf in each tree."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # bounded by trees * sample / leaf directions
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(vector))
            leaves = np.stack([lead(tree, x) for tree in shared.value], 1) if len(x) else np.empty((0, 0), np.int32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * leaves.shape[1], pa.int32())
            packed = pa.ListArray.from_arrays(ends, pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), packed], [key, vector, "leaves"])

    return vectors.mapInArrow(run, f"{key} {kind}, {vector} array<double>, leaves array<int>")


def search(
    vectors: DataFrame, asked: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, share: float = SHARE, sample: int = SAMPLE, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest rows found for each row of ``asked``, or all if fewer.

    Nearest first by Euclidean distance, ties to the smaller key.  Rows whose key is null, and vectors that are null,
    zero, of another length than most, or hold null or non-finite components take no part.  Rows that share
    a key with the query are its own; rows that repeat a key and its vector count once.  Keys are integers, and a key's
    smallest vector is its query.
    """
    spark = vectors.sparkSession
    rows = spread_rows(usable(vectors, key, vector))
    forest, length = fit(rows, key, vector, trees, sample, leaf)
    result = f"query_id {vectors.schema[key].dataType.simpleString()}, {key} long, score double"
    if not forest:
        return spark.createDataFrame([], result).select("query_id", F.lit(0).alias("rank"), key, "score")
    own_length = F.size(vector) == length
    placed = stored(index(rows.filter(own_length), forest, key, vector))
    n_leaves = sum(map(count_leaves, forest))
    held = np.zeros(n_leaves, np.int64)
    for one, n in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        held[one] = n  # one row per leaf of the forest
    enough = max(share * held.sum() / len(forest), LEAST)
    ways = spark.sparkContext.broadcast((forest, held))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held = ways.value
        for batch in batches:
            found = [reach(trees, x, held, enough) for x in matrix(batch.column(vector))]
            packed = pa.array([np.packbits(np.isin(np.arange(len(held)), f)).tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), packed], [key, vector, "leaves"])

    queries = usable(asked, key, vector).filter(own_length).groupBy(key).agg(F.min(vector).alias(vector))
    queries = stored(queries.mapInArrow(walk, f"{key} long, {vector} array<double>, leaves binary"))
    found = None
    for block in _blocks(queries, key, vector):
        part = _scan(placed, block, n_leaves, k, key, vector)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], result).select("query_id", F.lit(0).alias("rank"), key, "score")
    ranked = found.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", key)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """At most QUERIES_IN_BLOCK queries at a time, whatever their number."""
    ids, xs, ways = [], [], []

    def block():
        return np.array(ids, np.int64), np.array(xs, np.float64), list(ways)

    for one in queries.toLocalIterator():
        ids.append(one[0])
        xs.append(one[1])
        ways.append(bytes(one[2]))
        if len(ids) == QUERIES_IN_BLOCK:
            yield block()
            ids, xs, ways = [], [], []
    if ids:
        yield block()


def _scan(placed: DataFrame, block: tuple, n_leaves: int, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, key, score): the best k rows of each task for each query of the block."""
    shared = placed.sparkSession.sparkContext.broadcast(block)  # at most QUERIES_IN_BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, ways = shared.value
        visits = np.unpackbits(np.frombuffer(b"".join(ways), np.uint8).reshape(len(ways), -1), axis=1)[:, :n_leaves]
        visits = visits.astype(bool)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                x, leaves = matrix(part.column(vector)), matrix(part.column("leaves"))
                ids = part.column(key).to_numpy().astype(np.int64)
                for i, far, who in nearest_in(x, ids, leaves, q, q_ids, visits, k):
                    if i in best:
                        far, who = np.append(best[i][0], far), np.append(best[i][1], who)
                        by = np.lexsort((who, far))
                        again = (np.diff(far[by]) == 0) & (np.diff(who[by]) == 0)
                        first = by[np.append(True, ~again)][:k]
                        far, who = far[first], who[first]
                    best[i] = far, who
        if best:
            ids = np.repeat(q_ids[list(best)], [len(b[1]) for b in best.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.concatenate([b[1] for b in best.values()])),
                 pa.array(np.concatenate([b[0] for b in best.values()]))],
                ["query_id", key, "score"],
            )

    return placed.mapInArrow(run, f"query_id long, {key} long, score double")


@query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
