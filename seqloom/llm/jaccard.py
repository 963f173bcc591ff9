"""Jaccard self-join of documents on word n-grams, and the groups it links.

Documents of one shingle set are one class.  Each class posts the rarest shingles of its set, as many as a
similar set must share at least one of (prefix filter).  Pairs of classes that meet at a shingle pass
by their sizes (length filter), by the places of the shingle in both (positional filter) and by how many shingles
both post; the pairs left are unique, their sets are compared first by how many shingles fall into each range of hashes (suffix
filter) and then in full, once.

Classes of one large group of near copies would meet in all pairs.  So pairs are made in two steps that
lose no link between groups: first each class with the first of each list, which is one with few shingles of its
own; the links found among them make groups; then all pairs along the lists whose groups still differ.  A
pair inside one group cannot change the groups.

Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import Scratch, grouped, query, stored, sum_vectors, table, texts, with_size_check
from seqloom.llm.components import components
from seqloom.llm.hashing import WordHasher, shingle_sets

#: Shingles are counted in so many buckets (a power of two), which a task hands over in parts.
BUCKETS, PART = 1 << 22, 1 << 16
SHIFT = np.uint64(42)  # the bucket is in the hash's highest bits
#: Characters of documents that are cut into shingles together.
TOGETHER = 1 << 18
#: Up to so many class ids are sent to all tasks to pick the sets to compare; beyond that they are joined.
SENT = 1 << 21
#: Ranges of hashes that the suffix filter counts in.
RANGES = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


def set_id(shingles: np.ndarray) -> int:
    """The class of a set; sets without shingles have none (0)."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True) if len(shingles) else 0


def sets_of(batches: Iterator[pa.RecordBatch], key: str, text: str, size: int) -> Iterator[tuple]:
    """(key array, [set of each text]) for groups of texts."""
    hasher = WordHasher()
    for keys, group in grouped(batches, key, text, TOGETHER):
        yield keys, list(shingle_sets(hasher, group, size))


def _new_sets(batches, key, text, size) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) once for each class in the task."""
    seen = {0}
    for _, sets in sets_of(batches, key, text, size):
        for one in sets:
            own = set_id(one)
            if own not in seen:
                seen.add(own)
                yield own, one


def classes_and_counts(docs: DataFrame, size: int, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(key, id, n) of every document, and how many classes have a shingle in each bucket."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        seen = {0}
        names = [key, "id", "n", "part", "counts"]
        key_type = None
        for keys, sets in sets_of(batches, key, text, size):
            key_type = keys.type
            ids = [set_id(one) for one in sets]
            for own, one in zip(ids, sets):
                if own not in seen:
                    seen.add(own)
                    np.add.at(counts, (one >> SHIFT).astype(np.int64), 1)
            n = pa.array([len(one) for one in sets], pa.int64())
            none = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), n, *none], names)
        if key_type is not None:
            parts = counts.reshape(-1, PART)
            packed = [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), key_type), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()),
                 pa.array(range(len(parts)), pa.int32()), pa.array(packed, pa.binary())],
                names,
            )

    both = stored(texts(docs, key, text).mapInArrow(run, f"{key} {kind}, id long, n long, part int, counts binary"))

    parts = both.filter("part is not null").select("part", F.col("counts").alias("vector"))
    counts = sum_vectors(parts, np.int64)
    counts = np.zeros(BUCKETS, np.int64) if counts is None else counts
    return both.filter("part is null").select(key, "id", "n"), counts


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any similar set."""
    return (n * percent + 99) // 100


#: Rounds in which classes meet one other class of a list that their group is not part of, before all pairs do.
STARS = 2
#: A posting's packed place: weight above, then the set's size, then the shingle's place in the set's order.
BITS = 28


def postings(docs: DataFrame, counts: np.ndarray, size: int, percent: int, key: str, text: str) -> DataFrame:
    """(shingle, id, packed): the prefix of each class, rarest shingles first.

    Packed postings of a shingle sort by how common the prefix is on the whole: of a group of near copies the one with
    the fewest changes of its own comes first.
    """
    # fixed size; only the order matters, so that counts beyond 2^32 may be equal
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        out, waiting = [], 0

        def flush():
            ids, shingles, packed = zip(*out)
            lengths = [len(s) for s in shingles]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)),
                 pa.array(np.concatenate(packed))],
                ["shingle", "id", "packed"],
            )

        for own, one in _new_sets(batches, key, text, size):
            held = counts[(one >> SHIFT).astype(np.int64)]
            order = np.argsort(held, kind="stable")[: len(one) - needed(len(one), percent) + 1]
            weight = max(0, 127 - int(4 * np.log2(held[order] + 1.0).mean()))
            packed = (weight << 2 * BITS) + (len(one) << BITS) + np.arange(len(order), dtype=np.int64)
            out.append((own, one[order], packed))
            waiting += len(order)
            if waiting >= 200_000:
                yield flush()
                out, waiting = [], 0
        if out:
            yield flush()

    return texts(docs, key, text).mapInArrow(run, "shingle long, id long, packed long")


FIELD = (1 << BITS) - 1


def _unpacked(packed: Column | str) -> tuple[Column, Column]:
    """Size of the set and place of the shingle in its order."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    field = F.lit(FIELD).cast("long")
    return F.shiftright(packed, BITS).bitwiseAND(field), packed.bitwiseAND(field)


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Length and positional filter for two packed postings of a shingle that is the first their sets share.

    Sets that link share at least o = ceil(t (|a| + |b|) / (1 + t)) shingles.  Both have their shingles in one
    order, so that they share at most this shingle and what stands after it in either.  A pair that links passes
    at the first shingle it shares, though perhaps at no other.
    """
    (n_a, at_a), (n_b, at_b) = _unpacked(a), _unpacked(b)
    most = F.least(n_a - at_a, n_b - at_b)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most * (100 + percent) >= (n_a + n_b) * percent)


def enough(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets may link of whose prefixes ``both`` shingles are shared.

    The prefix that ends first in the common order holds all that its set shares up to there; so two sets share at
    most the shingles that both post and what the larger rest behind a prefix holds.
    """
    rest = F.floor((F.greatest(n_a, n_b) * percent + 99) / 100) - 1
    return (both + rest) * (100 + percent) >= (n_a + n_b) * percent


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the class that stands first in most of its lists, of ``lists`` (id, packed, first_id, first_packed)."""
    met = lists.filter((F.col("id") != F.col("first_id")) & may_link(F.col("packed"), F.col("first_packed"), percent))
    met = met.groupBy("id", "first_id").agg(F.count("*").alias("both"))
    best = met.groupBy("id").agg(F.max(F.struct("both", "first_id")).alias("best")).select("id", F.col("best.first_id").alias("other"))
    return best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes from different groups that may link, of ``lists`` (shingle, id, packed, root)."""
    x = lists.select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("id", "packed", "root")])
    y = lists.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("id", "packed", "root")])
    met = x.hint("merge").join(y, "shingle").filter(
        (F.col("root_x") != F.col("root_y")) & (F.col("id_x") < F.col("id_y"))
        & may_link(F.col("packed_x"), F.col("packed_y"), percent)
    )
    pairs = met.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
    # classes of different groups share open lists only, so these hold all that a pair shares
    held = lists.groupBy("id").agg(F.collect_list("shingle").alias("open"), F.max(_unpacked("packed")[0]).alias("n"))
    a, b = (held.select(F.col("id").alias(c), F.col("open").alias(f"open_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    full = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
    both = F.size(F.array_intersect("open_a", "open_b"))
    return full.filter(enough(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def meeting(docs: DataFrame, counts: np.ndarray, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Postings of the shingles that several classes post, each with the first posting of its list."""
    order = W.partitionBy("shingle").orderBy("packed", "id")
    near = postings(docs, counts, size, percent, key, text).select(
        "*",
        F.first("id").over(order).alias("first_id"),
        F.first("packed").over(order).alias("first_packed"),
        F.lag("id").over(order).alias("before"),
        F.lead("id").over(order).alias("after"),
    )
    # a class that several tasks have posted stands beside itself; its last posting stays
    last = F.col("after").isNull() | (F.col("after") != F.col("id"))
    several = (F.col("first_id") != F.col("id")) | F.col("after").isNotNull()
    return near.filter(last & several).select("shingle", "id", "packed", "first_id", "first_packed")


def verified(
    scratch: Scratch, docs: DataFrame, pairs: DataFrame, size: int, percent: int, key: str, text: str
) -> DataFrame:
    """(a, b, linked): each pair of classes compared in full.

    The texts travel, as they are smaller than their sets of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), {0}
        for _, group in grouped(batches, key, text, TOGETHER):
            ids = [set_id(one) for one in shingle_sets(hasher, group, size)]
            new = [i for i, own in enumerate(ids) if own not in seen and not seen.add(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in new], pa.int64()), pa.array([group[i] for i in new], pa.string())], ["id", "words"]
            )

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    every = texts(docs, key, text).mapInArrow(run, "id long, words string")
    kept = scratch.keep(with_size_check(every, ids, ["id"], "left_semi", SENT))
    one = kept.groupBy("id").agg(F.min("words").alias("words"))  # several tasks may have met copies of a class
    first = one.select(F.col("id").alias("a"), F.col("words").alias("of_a"))
    second = one.select(F.col("id").alias("b"), F.col("words").alias("of_b"))
    met = pairs.select("a", "b").hint("merge").join(first, "a").hint("merge").join(second, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                both = [x for c in ("of_a", "of_b") for x in part.column(c).to_pylist()]
                sets = list(shingle_sets(hasher, both, size))
                half = len(sets) // 2
                linked = [similar(x, y, percent) for x, y in zip(sets[:half], sets[half:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
                )

    compared = scratch.keep(met.mapInArrow(compare, "a long, b long, linked boolean"))
    scratch.drop(kept)
    return compared


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent / 100 or more."""
    total = len(a) + len(b)
    in_a = np.diff(np.searchsorted(a, RANGES), prepend=0, append=len(a))
    in_b = np.diff(np.searchsorted(b, RANGES), prepend=0, append=len(b))
    most = int(np.minimum(in_a, in_b).sum())
    if most * (100 + percent) < total * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (100 + percent) >= total * percent


def _open(scratch: Scratch, near: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, id, packed, root) of the lists that hold several groups."""
    named = roots.withColumnRenamed("node", "id")
    known = with_size_check(near.select("shingle", "id", "packed"), named, ["id"], "left", SENT)
    known = known.withColumn("root", F.coalesce("root", "id"))
    mixed = known.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = scratch.keep(mixed.filter("low <> high").select("shingle"))
    return scratch.keep(with_size_check(known, mixed, ["shingle"], "left_semi", SENT))


def link(docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id is the smallest key that links reach.

    Null and empty texts, and texts without words, have no shingles and link with nothing, nor with each
    other.  Rows with equal keys are rows of their own; a row whose key is null links others but lends no
    component its key.
    """
    scratch = Scratch(docs.sparkSession)
    documents, counts = classes_and_counts(docs, size, key, text)
    near = scratch.keep(meeting(docs, counts, size, percent, key, text))
    first = verified(scratch, docs, scratch.keep(stars(near, percent)), size, percent, key, text)
    links = first.filter("linked").select("a", "b")
    roots = components(links)
    order = W.partitionBy("shingle").orderBy("packed", "id")
    for _ in range(STARS):
        open_lists = _open(scratch, near, roots)
        # the first class of the list's first group meets the others
        again = open_lists.withColumns(
            {"first_id": F.first("id").over(order), "first_packed": F.first("packed").over(order), "of": F.first("root").over(order)}
        ).filter("root <> of")
        step = scratch.keep(stars(again, percent).join(first.select("a", "b"), ["a", "b"], "left_anti"))
        if step.isEmpty():
            break
        more = verified(scratch, docs, step, size, percent, key, text)
        first = scratch.keep(first.unionByName(more))
        links = first.filter("linked").select("a", "b")
        roots = components(links)

    # all pairs along the lists whose groups still differ
    open_lists = _open(scratch, near, roots)
    rest = scratch.keep(across(open_lists, percent).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = verified(scratch, docs, rest, size, percent, key, text).filter("linked").select("a", "b")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    scratch.drop(near, first, open_lists, rest)

    least = documents.filter("n > 0").groupBy("id").agg(F.min(key).alias("least"))
    grouped_by = least.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = grouped_by.groupBy("root").agg(F.min("least").alias("component_id"))
    reach = grouped_by.join(smallest, "root").select("id", "component_id")
    linked = documents.filter("n > 0").hint("merge").join(reach, "id").select(key, F.col("n").alias("n_shingles"), "component_id")
    alone = documents.filter("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return linked.unionByName(alone)


@query("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that every document belongs to."""
    return link(table(spark, sf_dir, "documents"))
