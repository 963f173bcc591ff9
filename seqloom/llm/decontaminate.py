"""Benchmark decontamination on a positional inverted index that is stored in segments.

A segment holds some documents: for every test term in them the sorted list of its positions, documents
laid end to end with a gap between.  Segments are rows, so they spread like documents do, and no list is
longer than its segment, however common the term.  A search takes the windows of the test items, puts the
terms of each window in order of their list lengths, starts from the rarest list minus the term's
offset, and intersects with the next rarest until none or all are left.  Exact phrases ask for each term
at its place, proximity matches for each term within ``slop`` places of it.

The test items come to the tasks in blocks of bounded size; each block is searched against all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import grouped, query, stored, table, texts

#: Bytes of test texts in a block; one longer item is a block of its own.
BLOCK = 8 << 20
#: Characters of documents in a segment; one longer document is a segment of its own.
SEGMENT = 1 << 20
#: Candidates that are looked at together.
TOGETHER = 1 << 20

_A_TO_Z = range(0x41, 0x5B)
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_WORD_TABLE = bytes(b + 32 if b in _A_TO_Z else b if b in _WORD_BYTES else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; words are stretches of digits, letters and everything beyond ASCII."""
    return text.encode("utf-8").translate(_WORD_TABLE).split()


@dataclass
class Items:
    """A block of test items: their terms end to end, and where each begins."""

    names: list[str]
    vocabulary: dict[bytes, int]
    terms: np.ndarray
    starts: np.ndarray

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows x length terms, item of each window), for each length that occurs."""
        sizes = np.diff(self.starts)
        for size in sorted({min(length, n) for n in sizes.tolist() if n}):
            places, owners = [], []
            for item in np.flatnonzero(sizes == size if size < length else sizes >= length):
                first = np.arange(self.starts[item], self.starts[item + 1] - size + 1)
                places.append(first)
                owners.append(np.full(len(first), item))
            yield sliding_window_view(self.terms, size)[np.concatenate(places)], np.concatenate(owners)


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The items that have words, a bounded number of bytes at a time."""

    def block(rows):
        vocabulary: dict[bytes, int] = {}
        terms, starts = [], [0]
        for _, found in rows:
            terms.extend(vocabulary.setdefault(w, len(vocabulary)) for w in found)
            starts.append(len(terms))
        return Items([n for n, _ in rows], vocabulary, np.array(terms, np.int32), np.array(starts, np.int64))

    rows, size = [], 0
    asked = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
    for name, one in asked.toLocalIterator():
        found = words(one)
        if not found:
            continue
        rows.append((name, found))
        size += sum(map(len, found)) + len(found)
        if size >= BLOCK:
            yield block(rows)
            rows, size = [], 0
    if rows:
        yield block(rows)


def build_index(docs: DataFrame, items, gap: int, key: str, text: str) -> DataFrame:
    """One row per segment: keys, digests and word counts of its documents, and the packed posting lists."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value["vocabulary"]
        for keys, group in grouped(batches, key, text, SEGMENT):
            ids, sizes = [], []
            for one in group:
                found = words(one)
                sizes.append(len(found))
                ids.append(np.fromiter((vocabulary.get(w, -1) for w in found), np.int32, len(found)))
                ids.append(np.full(gap, -1, np.int32))
            ids = np.concatenate(ids)
            places = np.flatnonzero(ids >= 0)
            places = places[np.argsort(ids[places], kind="stable")]
            terms, counts = np.unique(ids[places], return_counts=True)
            steps = np.diff(places, prepend=0).astype(np.int32)
            digests = [int.from_bytes(xxhash.xxh3_64_digest(one.encode("utf-8")), "big", signed=True) for one in group]
            packed = [zlib.compress(a.astype(np.int32).tobytes(), 1) for a in (terms, counts, steps)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([digests], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    *(pa.array([p], pa.binary()) for p in packed),
                ],
                ["keys", "digests", "sizes", "terms", "counts", "steps"],
            )

    schema = f"keys array<{kind}>, digests array<long>, sizes array<long>, terms binary, counts binary, steps binary"
    return texts(docs, key, text).mapInArrow(run, schema)


def matches(
    dense: np.ndarray, first: np.ndarray, lengths: np.ndarray, places: np.ndarray, windows: np.ndarray, slop: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of every proximity match; those at the exact places are marked.

    ``dense`` is the segment's term at each position; a list intersection looks the term up there.
    """
    need = lengths[windows]
    alive = np.flatnonzero(need.min(1) > 0)
    need = need[alive]
    order = np.argsort(need, axis=1, kind="stable")
    rarest = order[:, 0]
    found = need[np.arange(len(alive)), rarest]
    total = np.cumsum(found)
    begin = 0
    while begin < len(alive):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + TOGETHER, "right")))
        n = found[begin:end]
        w = np.repeat(np.arange(begin, end), n)
        nth = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        start = places[first[windows[alive[w], rarest[w]]] + nth] - rarest[w]
        exact = np.ones(len(w), bool)
        for k in range(1, windows.shape[1]):
            offset = order[w, k]
            term, at = windows[alive[w], offset], start + offset
            here = dense[at] == term
            near = here.copy()
            for step in range(1, slop + 1):
                near |= dense[at - step] == term
                near |= dense[at + step] == term
            exact &= here
            w, start, exact = w[near], start[near], exact[near]
        yield alive[w], start, exact
        begin = end


def search_index(segments: DataFrame, items, kind: str, length: int, slop: int, gap: int) -> DataFrame:
    """(key, digest, n_words, spans, items, near_items) for every document of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Items(**items.value)
        windows = list(asked.windows(length))
        vocabulary = len(asked.vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                sizes = batch.column("sizes")[i].values.to_numpy()
                digests = batch.column("digests")[i].values
                terms, counts, steps = (
                    np.frombuffer(zlib.decompress(batch.column(c)[i].as_py()), np.int32)
                    for c in ("terms", "counts", "steps")
                )
                bases = np.cumsum(sizes + gap) - sizes
                places = np.cumsum(steps, dtype=np.int64) + gap
                dense = np.full(int(sizes.sum()) + gap * (len(sizes) + 1), -1, np.int32)
                dense[places] = np.repeat(terms, counts)
                lengths, first = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
                lengths[terms], first[terms] = counts, np.cumsum(counts) - counts
                marks = np.zeros(len(dense) + 1, np.int64)
                hit: list[set] = [set() for _ in sizes]
                near: list[set] = [set() for _ in sizes]
                for wins, owners in windows:
                    for w, start, exact in matches(dense, first, lengths, places, wins, slop):
                        doc = np.searchsorted(bases, start + wins.shape[1] - 1, "right") - 1
                        inside = exact & (start >= bases[doc])
                        np.add.at(marks, start[inside], 1)
                        np.add.at(marks, start[inside] + wins.shape[1], -1)
                        for sets, mask in ((hit, inside), (near, np.ones(len(w), bool))):
                            both = np.unique(doc[mask] * len(asked.names) + owners[w[mask]])
                            for one in both.tolist():
                                sets[one // len(asked.names)].add(asked.names[one % len(asked.names)])
                covered = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
                turns = np.flatnonzero(covered[1:] != covered[:-1])
                begins, ends = turns[0::2], turns[1::2]
                doc = np.searchsorted(bases, begins, "right") - 1
                spans: list[list] = [[] for _ in sizes]
                for d, s, e in zip(doc.tolist(), (begins - bases[doc]).tolist(), (ends - bases[doc]).tolist()):
                    spans[d].append({"start": s, "end": e})
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        digests,
                        pa.array(sizes, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(s) for s in hit], pa.list_(pa.string())),
                        pa.array([sorted(s) for s in near], pa.list_(pa.string())),
                    ],
                    ["key", "digest", "n_words", "spans", "items", "near_items"],
                )

    schema = (
        f"key {kind}, digest long, n_words long, spans array<struct<start:long,end:long>>, "
        "items array<string>, near_items array<string>"
    )
    return segments.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    slop: int = 2,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, n_words, spans, items, near_items), one row for each row of ``docs``.

    ``spans`` are the word ranges inside any exact occurrence of a window, ``items`` the items such
    windows belong to, ``near_items`` those with a proximity match (exact ones among them).  A window is
    ``length`` consecutive words of an item; an item of fewer words is one window, one without words none.
    Null and empty texts have no words.  Rows with equal keys are searched one by one; repeated items count
    once, and an item whose key is null is named "null".
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    gap = length + slop + 1
    parts = []
    for block in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(vars(block))  # at most BLOCK bytes of words, or one item
        index = stored(build_index(docs, shared, gap, key, text))
        parts.append(search_index(index, shared, kind, length, slop, gap))
    if not parts:
        nothing = Items([], {}, np.zeros(0, np.int32), np.zeros(1, np.int64))
        shared = spark.sparkContext.broadcast(vars(nothing))
        parts.append(search_index(build_index(docs, shared, gap, key, text), shared, kind, length, slop, gap))
    if len(parts) == 1:
        return parts[0].drop("digest").withColumnRenamed("key", key)
    # several blocks: equal rows of one text have equal results, and sets of them stay as short as the blocks
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    merged = every.groupBy("key", "digest", "n_words").agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near_items")))).alias("near_items"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    )
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.named_struct(
                        F.lit("start"), F.element_at(done, -1)["start"],
                        F.lit("end"), F.greatest(F.element_at(done, -1)["end"], s["end"]),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return merged.select(
        F.col("key").alias(key), "n_words", joined.alias("spans"), "items", "near_items",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is in ten-word windows of the benchmark, and of which items."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
