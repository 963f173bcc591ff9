"""Exact nearest neighbours, neighbour votes and local outlier factors.

Rows are compared in tiles: a block of queries keeps its best k so far, and of the next tile only rows that can still be among
them are measured exactly; which these are is told by bounds in short numbers.  A training table of a checked small size is
broadcast.  A larger one is cut into chunks of bounded size around pivots, and the chunks are put into groups that a task can
hold.  A query first meets one chunk near it, which bounds how far its k-th neighbour can be, and is then copied only to
those groups that have a chunk which the triangle inequality cannot rule out; a task holds one group, and the queries
pass by.  Both ways emit k rows per query and group, never all pairs.

Keys can be of any type that can be ordered; equal distances go by key.  Rows without a vector take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.dependence import matrix
from seqloom.operators.quantiles import exact_quantiles, skewed_lookup
from seqloom.operators.streams import in_turn, lined_up
from seqloom.session import cut, spread_rows

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 1 << 15
#: Pivots at most, and those of them to which every chunk has its least and its largest distance.
PIVOTS, RINGS = 256, 16
#: Queries that meet a group in one task at most, queries of a block, rows of a tile, and pairs that are measured together.
LANE, QUERIES, TILE, PAIRS = 1 << 16, 256, 2048, 1 << 14
#: Rows of a group of chunks, about; tasks per core that they and their queries are dealt to, and queries that are worth a task.
HELD, SEATS, LEAST = 1 << 16, 2, 1 << 10
#: Largest sum of whole numbers, and queries whose sums are made together so that they stay in the cache.
SUM, SUMMED = (1 << 15) - 1, 64
#: Rows of a box at most, and queries that ask for boxes together.
BOXED, ASKING = 32, 128


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distance of each row of a to each row of b, in slices that fit the cache."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        gap = np.abs(a[i : i + step, None, :] - b[None, :, :])
        if p == 2:
            out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
        elif p == 1:
            out[i : i + step] = gap.sum(axis=2)
        else:
            out[i : i + step] = (gap**p).sum(axis=2) ** (1 / p)
    return out


def _tile_pairs(q, t, k: int, p: float, limit: np.ndarray, open_: np.ndarray | None):
    """(row of q, row of t, exact distance) of the pairs that can be among the k nearest, at most ``limit`` apart.

    Euclidean distances from one matrix product are off by rounding only, and whatever lies within that error is measured.
    """
    if p == 2:
        own, theirs = (q * q).sum(axis=1)[:, None], (t * t).sum(axis=1)[None, :]
        rough = own + theirs - 2 * (q @ t.T)
        slack = 1e-9 * (own[:, 0] + theirs.max()) + 1e-300
        edge = limit * limit
    else:
        rough, slack, edge = distances(q, t, p), 0.0, limit
    if open_ is not None:
        rough[~open_] = np.inf
    if len(t) > k:
        edge = np.minimum(edge, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
    i, j = np.nonzero(rough <= (edge + slack)[:, None])
    if open_ is not None:
        i, j = i[open_[i, j]], j[open_[i, j]]
    if p != 2:
        return i, j, rough[i, j]
    d = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        gap = q[i[s : s + PAIRS]] - t[j[s : s + PAIRS]]
        d[s : s + PAIRS] = np.sqrt((gap * gap).sum(axis=1))
    return i, j, d


def _measured(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, p: float) -> np.ndarray:
    """Exact distances of row i of q to row j of x, for p 1 and 2."""
    d = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        gap = q[i[s : s + PAIRS]] - x[j[s : s + PAIRS]]
        d[s : s + PAIRS] = np.abs(gap).sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))
    return d


class Held:
    """Training rows with what tells quickly that a row is too far: a lower bound of every distance.

    For p = 2 half the squared distance less the query's share, from one product of 32-bit matrices around the middle; the
    error of its rounding is at most a share of both lengths and is taken off.  For p = 1 the distance of whole numbers, as steps
    between the usual least and greatest value of a feature; what lies outside is moved to the end, which makes no distance greater,
    and whole steps are off by less than one each.  Other distances, and rows that are not finite, are measured outright.
    """

    def __init__(self, x: np.ndarray, p: float, codes: np.ndarray | None = None):
        self.x, self.p, self.codes = x, p, codes
        #: Rows at most that have one code.
        self.alike = 0 if codes is None or not len(codes) else int(np.unique(codes, return_counts=True)[1].max())
        self.short = None
        if p not in (1, 2) or not x.size or (p == 1 and SUM // x.shape[1] < 16) or not np.isfinite(x).all():
            return
        n, d = x.shape
        low, high = x.min(axis=0), x.max(axis=0)
        with np.errstate(over="ignore"):
            if not np.isfinite(d * (high - low)).all() or np.maximum(abs(low), abs(high)).max() > 1e150:
                return
        #: What a feature loses at most when it is moved to another origin.
        self.lost = 8 * np.finfo(float).eps * float(np.maximum(abs(low), abs(high)).max())
        if p == 2:
            self.origin = low / 2 + high / 2
            self.unit = float((high - low).max() / 2) or 1.0
            self.share = (d + 16) * 2.0**-22
            self.short = np.empty((n, d + 1), np.float32)
            for s in range(0, n, TILE):
                part = (x[s : s + TILE] - self.origin) / self.unit
                self.short[s : s + TILE, :d] = part
                self.short[s : s + TILE, d] = (0.5 - self.share) * (part * part).sum(axis=1)
        else:
            few = x[:: max(1, n // 1024)]
            usual = np.quantile(few, [0.01, 0.99], axis=0)
            margin = (usual[1] - usual[0]) / 2
            self.origin, end = np.maximum(low, usual[0] - margin), np.minimum(high, usual[1] + margin)
            self.steps = SUM // d
            self.unit = float((end - self.origin).max() / self.steps) or 1.0
            self.short = np.empty((d, n), np.int16)
            for s in range(0, n, TILE):
                self.short[:, s : s + TILE] = self._stepped(x[s : s + TILE]).T

    def _stepped(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.origin) / self.unit), 0, self.steps).astype(np.int16)

    def asked(self, q: np.ndarray):
        """A block of queries made short; None where they have to be measured outright."""
        if self.short is None or not len(q) or not np.isfinite(q).all() or np.abs(q).max() > 1e150:
            return None
        # a query far out loses more
        lost = max(self.lost, 8 * np.finfo(float).eps * float(np.abs(q).max()))
        if self.p == 1:
            return self._stepped(q), lost
        part = (q - self.origin) / self.unit
        if np.abs(part).max() > 1e6:
            return None
        own = (part * part).sum(axis=1)
        return np.hstack([-part, np.ones((len(q), 1))]).astype(np.float32), lost, own

    def bounds(self, asked, at) -> np.ndarray:
        """Queries by rows: what is at most ``edge`` where the distance is at most the query's limit."""
        if self.p == 2:
            return asked[0] @ self.short[at].T
        q, t = asked[0], np.ascontiguousarray(self.short[:, at])
        out = np.zeros((len(q), t.shape[1]), np.int16)
        for s in range(0, len(q), SUMMED):
            part, total = q[s : s + SUMMED], out[s : s + SUMMED]
            gap = np.empty_like(total)
            for f in range(len(t)):
                np.subtract(t[f], part[:, f : f + 1], out=gap)
                np.abs(gap, out=gap)
                np.add(total, gap, out=total)
        return out

    def edge(self, asked, limit: np.ndarray) -> np.ndarray:
        d = self.x.shape[1]
        if self.p == 1:
            steps = (limit + 2 * d * asked[1]) / self.unit * (1 + 1e-9) + d + 1
            return np.floor(np.minimum(steps, SUM)).astype(np.int16)
        _, lost, own = asked
        far = (limit + 2 * d * lost) / self.unit
        half = (far * far * (1 + 1e-9) - own) / 2 + self.share * own + 1e-30
        with np.errstate(over="ignore"):
            return np.nextafter(half.astype(np.float32), np.float32(np.inf))

    def pairs(self, q: np.ndarray, asked, at, k: int, best: np.ndarray, q_codes: np.ndarray | None):
        """(row of q, row, exact distance) of the pairs of a tile's rows that can be among the k nearest."""
        row = np.arange(at.start, min(at.stop, len(self.x))) if isinstance(at, slice) else at
        codes = None if q_codes is None else self.codes[at]
        if asked is None:
            i, j, d = _tile_pairs(q, self.x[at], k, self.p, best, None if codes is None else q_codes[:, None] != codes[None])
            return i, row[j], d
        bounds = self.bounds(asked, at)
        near = bounds <= self.edge(asked, best)[:, None]
        most = k + self.alike
        if len(row) > most and np.count_nonzero(near) > 4 * most * len(q):
            # the k-th of any rows that are measured is a limit
            j = np.argpartition(bounds, most - 1, axis=1)[:, :most].ravel()
            i = np.repeat(np.arange(len(q)), most)
            d = _measured(q, self.x, i, row[j], self.p)
            if codes is not None:
                d[q_codes[i] == codes[j]] = np.inf
            limit = np.partition(d.reshape(len(q), most), k - 1, axis=1)[:, k - 1]
            near = bounds <= self.edge(asked, np.minimum(best, limit))[:, None]
        i, j = np.divmod(np.flatnonzero(near), len(row))
        if codes is not None:
            other = q_codes[i] != codes[j]
            i, j = i[other], j[other]
        return i, row[j], _measured(q, self.x, i, row[j], self.p)


def nearest(
    q: np.ndarray, t: np.ndarray | Held, k: int, p: float, limit: np.ndarray | None = None,
    q_codes: np.ndarray | None = None, t_codes: np.ndarray | None = None, rows: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) of the k nearest rows of t, in order; equal distances go by row of t.

    ``limit`` leaves out what is farther away, equal codes leave out a query's own rows, ``rows`` (ascending) are those that
    are looked at.  Rows that are asked more than once are given as ``Held``, with their codes.  Memory is that of a tile.
    """
    held = t if isinstance(t, Held) else Held(t, p, t_codes)
    asked = held.asked(q)
    best = np.full(len(q), np.inf) if limit is None else limit.astype(float)
    row, column, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for start in range(0, len(held.x) if rows is None else len(rows), TILE):
        at = slice(start, start + TILE) if rows is None else rows[start : start + TILE]
        i, j, d = held.pairs(q, asked, at, k, best, q_codes)
        near = d <= best[i]
        if not near.any():
            continue
        row, column, far = np.append(row, i[near]), np.append(column, j[near]), np.append(far, d[near])
        order = np.lexsort((column, far, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
        row, column, far = row[order], column[order], far[order]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        # rows of later tiles come after equally distant ones
        last = np.searchsorted(row, full, "right") - 1
        best[full] = np.nextafter(far[last], -np.inf)
    return row, column, far


def top_k(q: np.ndarray, t: np.ndarray | Held, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns and exact distances of the k nearest rows of t, queries by places."""
    _, columns, d = nearest(q, t, k, p)
    shape = len(q), min(k, len(t.x if isinstance(t, Held) else t))
    return columns.reshape(shape), d.reshape(shape)


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in parts of at most ``most`` rows that lie near each other: halves along the widest feature, over and over."""
    parts, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        own = x[rows]
        spread = np.ptp(own, axis=0) if len(rows) > most else np.zeros(0)
        if not len(spread):
            parts.append(rows)
            continue
        half = len(rows) // 2
        order = np.argpartition(own[:, spread.argmax()], half)
        open_ += [rows[order[half:]], rows[order[:half]]]
    return parts


class Boxed:
    """Training rows in boxes, for many queries of which near ones ask together; Euclidean.

    The boxes nearest to a block of queries bound how far a k-th neighbour can be, and only boxes within that are looked into.
    Rows or queries that are not finite go without boxes.
    """

    def __init__(self, x: np.ndarray):
        self.held = Held(x, 2)
        self.rows = halved(x, BOXED) if len(x) and x.shape[1] and (np.abs(x) < 1e150).all() else []
        if self.rows:
            self.sizes = np.array([len(r) for r in self.rows])
            self.low, self.high = (np.stack([f(x[r], axis=0) for r in self.rows]) for f in (np.min, np.max))
            lengths = (x * x).sum(axis=1)
            self.wide, self.longest = np.hstack([x, lengths[:, None]]), lengths.max()

    def _gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distance, at least, from what lies between ``low`` and ``high`` to the boxes."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return (gap * gap).sum(axis=1)

    def _asked(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and distance, queries by places, of queries that are near each other."""
        wide = np.hstack([-2 * q, np.ones((len(q), 1))])  # squared distances from one matrix product, less the query's share
        slack = 1e-9 * ((q * q).sum(axis=1) + self.longest) + 1e-300  # rounding changes less
        gaps = self._gaps(q.min(axis=0), q.max(axis=0))
        order = np.argsort(gaps, kind="stable")
        first = order[: np.searchsorted(np.cumsum(self.sizes[order]), 2 * k) + 1]
        squared = wide @ self.wide[np.concatenate([self.rows[i] for i in first])].T
        squared.partition(k - 1, axis=1)
        edge = squared[:, k - 1] + slack
        farthest = (edge + (q * q).sum(axis=1) + slack).max() * (1 + 1e-9)
        rows = np.sort(np.concatenate([self.rows[i] for i in np.flatnonzero(gaps <= farthest)]))
        parts = []
        for s in range(0, len(rows), TILE):
            part = rows[s : s + TILE]
            squared = wide @ self.wide[part].T
            if len(part) > k:
                edge = np.minimum(edge, np.partition(squared, k - 1, axis=1)[:, k - 1] + slack)
            i, j = np.divmod(np.flatnonzero(squared <= (edge + slack)[:, None]), len(part))
            parts.append((i, part[j], _measured(q, self.held.x, i, part[j], 2)))
        i, j, d = parts[0] if len(parts) == 1 else (np.concatenate(c) for c in zip(*parts))
        if len(parts) > 1 or len(i) > k * len(q):
            order = np.lexsort((j, d, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
            return j[order].reshape(-1, k), d[order].reshape(-1, k)
        j, d = j.reshape(-1, k), d.reshape(-1, k)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(j, order, 1), np.take_along_axis(d, order, 1)

    def top_k(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As the function `top_k`, which looks at all rows."""
        if not self.rows or len(self.held.x) <= max(k, BOXED) or not np.isfinite(q).all() or np.abs(q).max(initial=0) > 1e150:
            parts = [top_k(q[s : s + QUERIES], self.held, k, 2) for s in range(0, max(1, len(q)), QUERIES)]
            return tuple(np.concatenate(c) for c in zip(*parts))
        columns, d = np.empty((len(q), k), np.int64), np.empty((len(q), k))
        for block in halved(q, ASKING) if len(q) else []:
            columns[block], d[block] = self._asked(q[block], k)
        return columns, d


def _codes(keys: pa.Array, of: pa.Array) -> np.ndarray:
    """Equal numbers for equal keys; -1 for a key that is not among the others."""
    return pc.fill_null(pc.index_in(keys, value_set=of), -1).to_numpy(zero_copy_only=False)


def _sides(queries: DataFrame, train: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x is not null")

    return spread_rows(side(queries), "id"), side(train)


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    key: str,
    vector: str,
    p: float = 2,
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, train_id, distance, place): the k nearest training rows of every query row."""
    q, t = _sides(queries, train, key, vector)
    size = t.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no training rows")
    if size["n"] * (size["d"] + 1) * 8 <= broadcast_bytes:
        return _against_broadcast(q, t, k, p, skip_self)
    return _against_chunks(q, t, k, p, skip_self, block_rows)


def _kind(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def _against_broadcast(q: DataFrame, t: DataFrame, k: int, p: float, skip_self: bool) -> DataFrame:
    table = t.toArrow()  # its size has been checked
    table = table.take(pc.sort_indices(table.column("id"))).combine_chunks()
    held = q.sparkSession.sparkContext.broadcast((table.column("id").combine_chunks(), matrix(table.column("x"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x = held.value
        codes = (lambda own: _codes(own, keys)) if skip_self else (lambda own: None)
        rows = Held(x, p, codes(keys))
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                part = batch.slice(start, QUERIES)
                row, column, d = nearest(matrix(part.column("x")), rows, k, p, None, codes(part.column("id")))
                # rows of one query come in order, so the place is known already
                place = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), keys.take(pa.array(column)), pa.array(d), pa.array(place.astype(np.int32))],
                    ["query_id", "train_id", "distance", "place"],
                )

    return q.mapInArrow(search, f"query_id {_kind(q)}, train_id {_kind(t)}, distance double, place int")


class _Directory:
    """What is known of the chunks without looking into them."""

    def __init__(self, pivots: np.ndarray, parts: np.ndarray, p: float):
        self.pivots, self.parts, self.p = pivots, parts, p
        self.first = np.cumsum(parts) - parts
        self.cell = np.repeat(np.arange(len(parts)), parts)

    def measured(self, chunk: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Directory:
        n = len(self.cell)
        self.radius, self.low, self.high = np.full(n, -np.inf), np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf)
        self.radius[chunk], self.low[chunk], self.high[chunk] = radius, low, high  # a chunk without rows is never visited
        return self

    def home(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """A chunk near each row: one of those of the nearest pivot that has any."""
        d = distances(x, self.pivots, self.p)
        d[:, self.parts == 0] = np.inf
        cell = d.argmin(axis=1)
        return self.first[cell] + number % self.parts[cell]

    def open(self, x: np.ndarray, bound: np.ndarray, of: slice = slice(None)) -> np.ndarray:
        """Rows by chunks: whether a chunk can hold anything at most ``bound`` away."""
        d = distances(x, self.pivots, self.p)
        least = d[:, self.cell[of]] - self.radius[of]
        rings, low, high = d[:, : self.low.shape[1]], self.low[of], self.high[of]
        for j in range(low.shape[1]):
            least = np.maximum(least, np.maximum(rings[:, j : j + 1] - high[:, j], low[:, j] - rings[:, j : j + 1]))
        # a little slack keeps rounding from ruling a chunk out
        return least <= (bound * (1 + 1e-9) + 1e-12)[:, None]


def _against_chunks(q: DataFrame, t: DataFrame, k: int, p: float, skip_self: bool, block_rows: int) -> DataFrame:
    spark = q.sparkSession
    q_kind, t_kind = _kind(q), _kind(t)
    n_train = t.count()
    # pivots: the rows with the smallest hashes, of bounded number
    chosen = t.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, math.ceil(n_train / block_rows)))).toArrow()
    pivots = spark.sparkContext.broadcast(matrix(chosen.column("x")))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column("x")), pivots.value, p)
                cell = d.argmin(axis=1)
                rings = d[:, :RINGS]
                ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * rings.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]),
                     pa.ListArray.from_arrays(ends, pa.array(rings.ravel()))],
                    ["id", "x", "cell", "off", "rings"],
                )

    celled = t.mapInArrow(to_cells, f"id {t_kind}, x array<double>, cell int, off double, rings array<double>")
    celled = cut(celled.withColumn("number", F.monotonically_increasing_id()))
    counts = dict(tuple(r) for r in celled.groupBy("cell").count().collect())  # one per pivot
    n_pivots = len(pivots.value)
    # a crowded cell becomes several chunks of bounded size
    parts = np.array([math.ceil(counts.get(c, 0) / block_rows) for c in range(n_pivots)])
    directory = _Directory(pivots.value, parts, p)
    number = lambda a: F.get(F.array(*[F.lit(int(v)) for v in a]), F.col("cell"))
    chunk = number(directory.first) + F.pmod("number", number(parts))
    chunks = celled.withColumn("chunk", chunk.cast("int"))
    together = max(1, HELD // block_rows)
    group = F.floor(F.col("chunk") / together).cast("int")
    n_rings = min(RINGS, n_pivots)
    aggs = [f(F.get("rings", F.lit(j))).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(n_rings)]
    known = chunks.groupBy("chunk").agg(F.max("off").alias("radius"), *aggs).toArrow()  # one row per chunk
    column = lambda c: known.column(c).to_numpy()
    ring = lambda n: np.stack([column(f"{n}{j}") for j in range(n_rings)], 1)
    ways = spark.sparkContext.broadcast(directory.measured(column("chunk"), column("radius"), ring("low"), ring("high")))

    def go_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = ways.value.home(matrix(batch.column("x")), batch.column("q").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["q", "id", "x", "chunk"])

    asked = cut(q.select(F.monotonically_increasing_id().alias("q"), "id", "x"))
    homes = asked.mapInArrow(go_home, f"q long, id {q_kind}, x array<double>, chunk int")

    def hold(rows: pa.Table) -> tuple:
        rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()
        keys = rows.column("id").combine_chunks()
        held = Held(matrix(rows.column("x")), p, _codes(keys, keys) if skip_self else None)
        chunk = rows.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")  # of a chunk, ascending
        return keys, held, chunk, order, chunk[order]

    def own(keys: pa.Array, part: pa.RecordBatch) -> np.ndarray | None:
        return _codes(part.column("asked").cast(keys.type), keys) if skip_self else None

    def at_home(held: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """How far the k-th neighbour can be, by the chunks near the askers of a block, and the groups that have a chunk within that."""
        keys, rows, _, order, in_order = held
        x = matrix(part.column("x"))
        near = [order[slice(*np.searchsorted(in_order, [c, c + 1]))] for c in np.unique(part.column("chunk"))]
        row, _, d = nearest(x, rows, k, p, None, own(keys, part), rows=np.sort(np.concatenate(near)))
        sizes = np.bincount(row, minlength=len(x))
        bound = np.full(len(x), np.inf)
        bound[sizes == k] = d[np.cumsum(sizes)[sizes == k] - 1]
        open_ = np.logical_or.reduceat(ways.value.open(x, bound), np.arange(0, len(ways.value.cell), together), axis=1)
        visits = pa.array(np.append(0, np.cumsum(open_.sum(axis=1))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("q"), part.column("asked"), part.column("x"), part.column("chunk"), pa.array(bound),
             pa.ListArray.from_arrays(visits, pa.array(np.nonzero(open_)[1].astype(np.int32)))],
            ["q", "asked", "x", "chunk", "bound", "visits"],
        )

    def visiting(held: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, rows, chunk, _, in_order = held
        x, bound = matrix(part.column("x")), part.column("bound").to_numpy()
        first = in_order[0] // together * together
        open_ = ways.value.open(x, bound, slice(first, first + together)).any(axis=0)[chunk - first]
        of = None if open_.mean() > 0.9 else np.flatnonzero(open_)
        row, at, d = nearest(x, rows, k, p, bound, own(keys, part), rows=of)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [part.column("q").take(take), part.column("asked").take(take), keys.take(pa.array(at)), pa.array(d)],
            ["q", "asked", "train_id", "distance"],
        )

    def meet(asking: DataFrame, answer, schema: str) -> DataFrame:
        """The askers of a group in lanes of bounded size, each with a copy of the group; near askers side by side."""
        crowds = dict(tuple(r) for r in asking.groupBy("group").count().collect())  # one per group
        tasks = SEATS * spark.sparkContext.defaultParallelism
        lane = min(LANE, max(LEAST, math.ceil(sum(crowds.values()) / tasks)))
        lanes = [math.ceil(crowds.get(g, 0) / lane) for g in range(math.ceil(len(directory.cell) / together))]
        of = F.get(F.array(*[F.lit(n) for n in lanes]), F.col("group"))
        before = F.get(F.array(*[F.lit(int(n)) for n in np.cumsum(lanes) - lanes]), F.col("group"))
        rows = chunks.select(group.alias("group"), "chunk", "id", "x").filter(of > 0)
        rows = rows.withColumn("seat", F.explode(F.sequence(before, before + of - 1)))
        asking = asking.withColumn("seat", (before + F.pmod("q", of)).cast("int"))
        met = lined_up(rows.drop("group"), asking.drop("group"), ["seat"], ["chunk"], max(1, sum(lanes)))
        return met.mapInArrow(lambda batches: in_turn(batches, ["seat"], hold, answer, QUERIES), schema)

    asked = f"q long, asked {q_kind}"
    homes = homes.withColumnRenamed("id", "asked").withColumn("group", group)
    first = cut(meet(homes, at_home, f"{asked}, x array<double>, chunk int, bound double, visits array<int>"))
    asking = first.select("q", "asked", "x", "chunk", "bound", F.explode("visits").alias("group"))
    near = meet(asking, visiting, f"{asked}, train_id {t_kind}, distance double")
    best = W.partitionBy("q").orderBy("distance", "train_id")
    ranked = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return ranked.select(F.col("asked").alias("query_id"), "train_id", "distance", "place")


def knn_classify(
    queries: DataFrame, train: DataFrame, k: int, key: str, vector: str, label: str,
    weights: str = "uniform", p: float = 2, skip_self: bool = False,
) -> DataFrame:
    """(query_id, p1): the share of the vote for label 1."""
    # the lookup reads its rows more than once
    near = cut(knn_join(queries, train, k, key, vector, p, skip_self))
    labels = train.select(F.col(key).alias("train_id"), F.col(label).alias("_y"))
    rows = skewed_lookup(near, labels, ["train_id"])
    exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(W.partitionBy("query_id"))
    if weights == "uniform":
        rows = rows.withColumn("_w", F.lit(1.0))
    elif weights == "distance":
        # a neighbour at no distance outvotes all others
        rows = rows.withColumn("_exact", exact).withColumn(
            "_w",
            F.when(F.col("_exact") == 1, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.col("distance")),
        )
    else:
        raise ValueError(f"unknown weights {weights}")
    return rows.groupBy("query_id").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("p1"))


def _density(near: DataFrame, k_distances: DataFrame) -> DataFrame:
    """(query_id, density): one over the mean reachability of the neighbours."""
    rows = skewed_lookup(near, k_distances, ["train_id"])
    reach = F.greatest("distance", "k_distance")
    return rows.groupBy("query_id").agg((1 / (F.avg(reach) + 1e-10)).alias("density"))


def lof_fit(train: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(train_id, k_distance, density, outlier) of the training rows, each without itself."""
    near = cut(knn_join(train, train, k, key, vector, skip_self=True))
    k_distances = cut(near.groupBy(F.col("query_id").alias("train_id")).agg(F.max("distance").alias("k_distance")))
    density = cut(_density(near, k_distances))
    of_neighbour = density.select(F.col("query_id").alias("train_id"), F.col("density").alias("_nd"))
    factor = (
        skewed_lookup(near, of_neighbour, ["train_id"])
        .groupBy("query_id")
        .agg(F.avg("_nd").alias("_mean"))
        .join(density, "query_id")
        .select(F.col("query_id").alias("train_id"), "density", (F.col("_mean") / F.col("density")).alias("outlier"))
    )
    return k_distances.join(factor, "train_id")


def lof_score(queries: DataFrame, train: DataFrame, fitted: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(query_id, outlier): mean density of the neighbours over the query's own; high is odd."""
    near = cut(knn_join(queries, train, k, key, vector))
    density = _density(near, fitted.select("train_id", "k_distance"))
    return (
        skewed_lookup(near, fitted.select("train_id", F.col("density").alias("_nd")), ["train_id"])
        .groupBy("query_id")
        .agg(F.avg("_nd").alias("_mean"))
        .join(density, "query_id")
        .select("query_id", (F.col("_mean") / F.col("density")).alias("outlier"))
    )


def fit_label(fitted: DataFrame, contamination: float = 0.1) -> DataFrame:
    """(train_id, label): -1 for the odd share of the training rows, 1 for the rest."""
    flipped = fitted.select("train_id", (-F.col("outlier")).alias("_s"))
    offset = exact_quantiles(flipped, [], "_s", {"offset": contamination}).select("offset")
    rows = flipped.crossJoin(F.broadcast(offset))
    return rows.select("train_id", F.when(F.col("_s") < F.col("offset"), -1).otherwise(1).alias("label"))
