"""Connected components of a table of links, by spanning forests and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

#: Links that a task joins to a forest.
LINKS = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every node of the partition's links and the smallest node it reaches there."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        end = node
        while above[end] != end:
            end = above[end]
        while above[node] != end:
            above[node], node = end, above[node]
        return end

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    if above:
        nodes = np.fromiter(above, np.int64, len(above))
        ends = np.fromiter(map(top, above), np.int64, len(above))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ends)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): nodes that links connect have one root.

    The links are dealt to tasks of bounded size, and each replaces its links by a forest of stars.  If that took
    one task, the stars are the components.  Else the stars are contracted: every node points to the neighbour,
    or itself, that comes first in an order drawn anew for the round; pointers are followed to their ends, and the
    ends are the nodes of the next round.  At least half of the linked nodes are expected to vanish in a round,
    and chains of pointers are short, as the order is random.  The minimum over a node's neighbours is taken
    before the shuffle, so that a node may have any number of them.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep(links.select("a", "b").filter("a <> b").distinct())
    roots = None

    def followed(points: DataFrame) -> DataFrame:
        """The roots so far, led on to where ``points`` leads them."""
        if roots is None:
            return points.select("node", "root")
        ends = points.select(F.col("node").alias("root"), F.col("root").alias("end"))
        return roots.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root"))

    turn = 0
    while n := edges.count():
        tasks = -(-n // LINKS)
        stars = edges.repartition(tasks).mapInArrow(_forest, "a long, b long")
        if tasks == 1:
            return scratch.keep(followed(stars.select(F.col("a").alias("node"), F.col("b").alias("root"))))
        stars = scratch.keep(stars.filter("a <> b").distinct())
        scratch.drop(edges)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = F.xxhash64("b", F.lit(turn))
        first = both.groupBy("a").agg(F.min(F.struct(place.alias("place"), F.col("b").alias("node"))).alias("first"))
        nearer = F.col("first.place") < F.xxhash64("a", F.lit(turn))
        root = F.when(nearer, F.col("first.node")).otherwise(F.col("a")).alias("root")
        points = scratch.keep(first.select(F.col("a").alias("node"), root))
        while True:  # each turn doubles how far a pointer reaches
            far = points.select(F.col("node").alias("root"), F.col("root").alias("end"))
            moved = (F.col("end") != F.col("root")).alias("moved")
            jumped = scratch.keep(points.join(far, "root").select("node", F.col("end").alias("root"), moved))
            scratch.drop(points)
            points = jumped
            if jumped.filter("moved").isEmpty():
                break
        found = scratch.keep(followed(points))
        a = points.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = points.select(F.col("node").alias("b"), F.col("root").alias("y"))
        met = stars.join(a, "a").join(b, "b").filter("x <> y")
        edges = scratch.keep(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(stars, points, *([roots] if roots is not None else []))
        roots = found
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots
