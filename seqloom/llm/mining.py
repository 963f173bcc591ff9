"""Hard negatives by segment summaries: bounds on scores from means and deviations, refined until few pairs are left.

A vector is cut into segments, of which the mean and the deviation are stored.  Over a segment the inner product of two
vectors is the length times the means' product, plus or minus at most the length times the deviations' product.
The sums over 1, 4 and 16 segments bound the score ever closer; a pair goes on only while its bounds allow that it
is among the best so far and inside the wanted band, and what is left is scored exactly, in whole numbers.

Rows are dealt to chunks of bounded size, in the order of their keys.  The anchors, in blocks, come to every chunk as a stream
behind its rows, so a task holds one chunk and one block, and no anchor passes through the driver.  A chunk hands
over the best of its rows for each anchor, and the best of all chunks are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import Scratch, bounded_batches, query, table

#: Segments of each refinement.
LEVELS = 1, 4, 16
#: Rows of a chunk at most, and rows that are worth a chunk of their own; anchors of a block.
ROWS, FEW, BLOCK = 1 << 16, 1 << 11, 256
#: Rows that are bounded together: few at first, while nothing is known of the best.
FIRST, TOGETHER = 64, 1 << 12
#: Scores beyond this are cut to it.
LARGEST = 1 << 62


class Vectors:
    """Whole-number vectors of one length with their segment summaries."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.exact = x.astype(np.float64)
        self.largest = float(np.abs(self.exact).max(initial=0))
        self.norms = np.sqrt((self.exact**2).sum(1))
        self.means, self.deviations = [], []
        for segments in LEVELS:
            parts = np.array_split(self.exact, min(segments, max(1, x.shape[1])), axis=1)
            # both times the root of the length, so that plain products are the bounds
            self.means.append(np.stack([p.sum(1) / np.sqrt(max(1, p.shape[1])) for p in parts], 1))
            self.deviations.append(np.stack([np.sqrt(((p - p.mean(1, keepdims=True)) ** 2).sum(1)) if p.shape[1] else p.sum(1) for p in parts], 1))

    def __len__(self) -> int:
        return len(self.x)


def scores(a: Vectors, at: np.ndarray, b: Vectors, to: np.ndarray, pairs: bool) -> np.ndarray:
    """Inner products as whole numbers: of the pairs (at, to), or of all of ``at`` with all of ``to``."""
    most = a.largest * b.largest * a.x.shape[1]
    if most < 2**53:  # then doubles add without rounding
        x, y = a.exact[at], b.exact[to]
        return (np.einsum("ij,ij->i", x, y) if pairs else x @ y.T).astype(np.int64)
    x, y = a.x[at], b.x[to]
    if most >= LARGEST:
        x, y = x.astype(object), y.astype(object)
    found = (x * y).sum(1) if pairs else x @ y.T
    return np.clip(found, -LARGEST, LARGEST).astype(np.int64)


def bounded(
    a: Vectors, b: Vectors, rows: np.ndarray, open_: np.ndarray, least: np.ndarray, most: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of the pairs with least <= score <= most, and how many pairs were scored exactly.

    ``open_``: anchors x rows, the pairs that may be looked at at all; ``least``, ``most``: one each per anchor.
    """
    who, open_ = np.arange(len(a)), open_ & (least <= most)[:, None]
    for mean_a, dev_a, mean_b, dev_b in zip(a.means, a.deviations, b.means, b.deviations):
        on, off = open_.any(1), open_.any(0)
        who, rows, open_ = who[on], rows[off], open_[on][:, off]
        if not open_.size:
            break
        middle, spread = mean_a[who] @ mean_b[rows].T, dev_a[who] @ dev_b[rows].T
        spread += 1e-9 * a.norms[who][:, None] * b.norms[rows] + 1e-6  # what rounding may have taken
        open_ &= (middle + spread >= least[who][:, None]) & (middle - spread <= most[who][:, None])
    i, j = np.nonzero(open_)
    if len(i) * 16 < open_.size:
        found, n = scores(a, who[i], b, rows[j], True), len(i)
    else:
        found, n = scores(a, who, b, rows, False)[i, j] if open_.size else np.empty(0, np.int64), open_.size
    i, j = who[i], rows[j]
    good = (found >= least[i]) & (found <= most[i])
    return i[good], j[good], found[good], n


def first(group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: highest scores, then smallest order."""
    by = np.lexsort((order, -score, group))
    run = group[by]
    return by[np.arange(len(by)) - np.searchsorted(run, run) < k]


class Best:
    """The first k rows of each of n questions so far; rows come in the order of their keys."""

    def __init__(self, n: int, k: int):
        self.k, self.group, self.row, self.score = k, *(np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, -LARGEST)  # a later row needs so much

    def add(self, group: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.group, self.row, self.score = (
            np.append(self.group, group), np.append(self.row, row), np.append(self.score, score)
        )
        keep = first(self.group, self.score, self.row, self.k)
        self.group, self.row, self.score = self.group[keep], self.row[keep], self.score[keep]
        full = np.bincount(self.group, minlength=len(self.least)) == self.k
        lowest = np.full(len(self.least), LARGEST)
        np.minimum.at(lowest, self.group, self.score)
        self.least[full] = lowest[full] + 1


def tiles(n: int) -> Iterator[tuple[int, int]]:
    start, size = 0, FIRST
    while start < n:
        yield start, min(n, start + size)
        start, size = start + size, min(TOGETHER, size * 4)


class Chunk:
    """Rows of one length, in the order of their keys."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.keys, self.labels, self.vectors = keys, labels, Vectors(x)
        self.by_label = np.argsort(labels, kind="stable")
        self.sorted_labels = labels[self.by_label]
        self.scored = 0

    def positives(self, keys: np.ndarray, labels: np.ndarray, a: Vectors, k: int) -> Best:
        """For each anchor the first k rows of its label and another key."""
        best, none = Best(len(a), k), np.full(len(a), LARGEST)
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            low, high = np.searchsorted(self.sorted_labels, [label, label + 1])
            members = self.by_label[low:high]
            for start, end in tiles(len(members)):
                rows = members[start:end]
                open_ = np.zeros((len(a), len(rows)), bool)
                open_[own] = keys[own][:, None] != self.keys[rows]
                i, j, s, n = bounded(a, self.vectors, rows, open_, best.least, none)
                self.scored += n
                best.add(i, j, s)
        return best

    def negatives(self, keys: np.ndarray, labels: np.ndarray, a: Vectors, low: np.ndarray, high: np.ndarray, k: int) -> Best:
        """For each anchor and band (anchors x bands; an empty band has low > high) the first k rows of another label."""
        bands = low.shape[1]
        best = Best(low.size, k)
        for start, end in tiles(len(self.keys)):
            rows = np.arange(start, end)
            need = np.maximum(low, best.least.reshape(low.shape))
            wanted = need <= high
            least = np.where(wanted, need, LARGEST).min(1, initial=LARGEST)
            most = np.where(wanted, high, -LARGEST).max(1, initial=-LARGEST)
            open_ = (labels[:, None] != self.labels[rows]) & (keys[:, None] != self.keys[rows])
            i, j, s, n = bounded(a, self.vectors, rows, open_, least, most)
            self.scored += n
            for band in range(bands):
                good = (s >= need[i, band]) & (s <= high[i, band])
                best.add(i[good] * bands + band, j[good], s[good])
        return best


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), length)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("vector").value_lengths().to_numpy()
    for n in np.unique(lengths):
        yield int(n), batch.filter(pa.array(lengths == n))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(held: list[pa.RecordBatch]) -> dict[int, Chunk]:
    out = {}
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        for n, own in _by_length(batch):
            out[n] = Chunk(_longs(own.column("key")), _longs(own.column("label")), _matrix(own.column("vector"), n))
    return out


def _streams(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Holds the rows of a chunk and gives ``answer`` the blocks of anchors that follow them."""
    chunk, held, ready = None, [], None
    for batch in batches:
        place = np.stack([_longs(batch.column("chunk")), _longs(batch.column("kind"))])
        ends = np.append(np.flatnonzero((np.diff(place) != 0).any(0)) + 1, batch.num_rows)
        start = 0
        for end in ends[ends > 0].tolist():
            part, (c, kind) = batch.slice(start, end - start), place[:, start].tolist()
            start = end
            if c != chunk:
                chunk, held, ready = c, [], None
            if kind == 0:
                held.append(part)
                continue
            if ready is None:
                ready, held = _chunks(held), []
            for at in range(0, part.num_rows, BLOCK):
                for n, block in _by_length(part.slice(at, BLOCK)):
                    if n in ready:
                        yield from answer(ready[n], block, n)


def _positives(k: int):
    def answer(chunk: Chunk, block: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
        best = chunk.positives(
            _longs(block.column("key")), _longs(block.column("label")), Vectors(_matrix(block.column("vector"), n)), k
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(_longs(block.column("anchor"))[best.group]), pa.array(chunk.keys[best.row]), pa.array(best.score)],
            ["anchor", "found", "score"],
        )

    return lambda batches: _streams(batches, answer)


def _negatives(k: int, positives: int, low: int, high: int):
    def answer(chunk: Chunk, block: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
        floors = np.full((block.num_rows, positives), 1, np.int64)
        ceilings = np.zeros_like(floors)
        for i, own in enumerate(block.column("wanted").to_pylist()):
            floors[i, : len(own)] = [-(-low * s // 100) for s in own]
            ceilings[i, : len(own)] = [high * s // 100 for s in own]
        best = chunk.negatives(
            _longs(block.column("key")), _longs(block.column("label")), Vectors(_matrix(block.column("vector"), n)),
            floors, ceilings, k,
        )
        who, band = np.divmod(best.group, positives)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_longs(block.column("anchor"))[who]), pa.array(band + 1), pa.array(chunk.keys[best.row]), pa.array(best.score)],
            ["anchor", "place", "found", "score"],
        )

    return lambda batches: _streams(batches, answer)


def _searched(rows: DataFrame, anchors: DataFrame, chunks: int, run, schema: str) -> DataFrame:
    """What ``run`` finds in each chunk of the rows for the anchors that are sent to all chunks."""
    there = rows.select(F.expr(f"int(pmod(row, {chunks}))").alias("chunk"), F.lit(0).alias("kind"), "key", "label", "vector")
    asked = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("kind", F.lit(1))
    both = there.unionByName(asked, allowMissingColumns=True)
    return both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "key").mapInArrow(run, schema)


def _ranked(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "found")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(
    rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products.

    For each row where ``anchors`` holds, its first ``positives`` rows of the same label; for each of these the first
    ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the positive's.  First is the
    highest score, then the smallest key.  Keys and labels are whole numbers, vectors array<long>.

    Rows whose key, label or vector is null, or whose vector holds a null, take no part; only vectors of equal length are
    compared.  Rows of an anchor's key are the anchor itself.  Rows that repeat others count as often as they are
    there, but equal anchors are asked once.  Scores beyond 2^62 are cut to it.  Other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    plain = rows.select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    ).filter("key is not null and label is not null and vector is not null and forall(vector, v -> v is not null)")
    stored = scratch.keep(plain.withColumn("row", F.monotonically_increasing_id()))
    n = stored.count()
    spread = min(2 * spark.sparkContext.defaultParallelism, -(-n // FEW))
    chunks = max(1, spread, -(-n // ROWS))
    asked = stored.filter("is_anchor").select("key", "label", "vector").distinct()
    asked = scratch.keep(asked.withColumn("anchor", F.monotonically_increasing_id()))
    near = _searched(stored, asked, chunks, _positives(positives), "anchor long, found long, score long")
    best = scratch.keep(_ranked(near, ["anchor"], positives, "place"))
    # at most ``positives`` rows per anchor
    wanted = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("own"))
    wanted = wanted.select("anchor", F.expr("transform(own, x -> x.score)").alias("wanted"))
    hard = _searched(
        stored, asked.join(wanted, "anchor"), chunks, _negatives(negatives, positives, low, high),
        "anchor long, place long, found long, score long",
    )
    ranked = _ranked(hard, ["anchor", "place"], negatives, "rank")
    pairs = best.select("anchor", F.col("place").cast("long").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        ranked.withColumnsRenamed({"found": "negative_id", "score": "negative_score"})
        .join(pairs, ["anchor", "place"])
        .join(asked.select("anchor", F.col("key").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def quantized(vectors: DataFrame, key: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """(key, label, vector array<long>): components times ``scale``, rounded down; vectors that are null or hold a null
    or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return vectors.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(key, label, whole.alias(vector))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same) t WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) t WHERE rank <= 3
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0, vector="embedding")
