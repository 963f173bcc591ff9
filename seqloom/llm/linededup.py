"""Reversible line deduplication: exact reference counts in shards, each behind a cuckoo filter.

A line's key is a 128-bit digest of the stripped, lower-cased line.  The exact table has one row per key:
the number of documents that hold it.  Inserting documents adds to the counts, deleting them subtracts,
and a key whose count falls to zero is gone, so any sequence of insertions and deletions leaves the table that
the remaining documents alone would give.  The keys found in enough documents are droppable; each shard's
cuckoo filter holds them, takes new ones in and lets others go.  A line is looked up in the filter of its
shard first, and only a line that the filter knows is looked up in the exact table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import fields, query, small, stored, table, texts

LOWER = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
#: Droppable keys in a shard, on average.
SHARD = 1 << 15
#: Up to so many droppable keys (16 bytes each) are sent to all tasks; beyond that the lines are joined.
SENT = 1 << 20
#: Distinct keys that a task counts before it hands them over.
COUNTED = 1 << 20


def line_keys(text: str) -> list[bytes]:
    """The key of each line; a blank line's key is empty."""
    return [line.strip().translate(LOWER) for line in text.encode("utf-8").split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """(keys x 2) signed 64-bit halves of 128-bit digests."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket, each in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * 0.5))))))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        prints = (hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (lo.view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, bucket, prints):
        return bucket ^ (prints.astype(np.int64) * 0x5BD1E995 >> 7 & self.buckets - 1)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(hi, lo)
        return ((self.cells[one] == prints[:, None]) | (self.cells[two] == prints[:, None])).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if there is no room; the caller then builds a larger filter from the exact table."""
        for mark, one, two in zip(*self.places(hi, lo)):
            for kick in range(self.KICKS):
                free = [(b, s) for b in (one, two) for s in np.flatnonzero(self.cells[b] == 0)[:1]]
                if free:
                    self.cells[free[0]] = mark
                    break
                slot = kick % self.SLOTS
                mark, self.cells[one, slot] = self.cells[one, slot], mark
                one = self.other(one, mark)
                two = one
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for mark, one, two in zip(*self.places(hi, lo)):
            for bucket in (one, two):
                slots = np.flatnonzero(self.cells[bucket] == mark)
                if len(slots):
                    self.cells[bucket, slots[0]] = 0
                    break


def _halves(keys: np.ndarray, n, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), n], names
    )


def reference_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(hi, lo, refs): in how many rows of ``docs`` each key occurs; a task adds up before it shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            n = pa.array(list(counts.values()), pa.int64())
            return _halves(np.frombuffer(b"".join(counts), "<i8").reshape(-1, 2), n, ["hi", "lo", "refs"])

        for batch in small(batches):
            for one in batch.column(text).to_pylist():
                found = set(line_keys(one))
                found.discard(b"")
                counts.update(map(xxhash.xxh3_128_digest, found))
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    counted = texts(docs, key, text).select(text).mapInArrow(run, "hi long, lo long, refs long")
    return counted.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"))


@dataclass
class LineIndex:
    """The exact table, and the filters of its droppable keys: (shard, buckets, cells)."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    droppable: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, text: str = "text", key: str = "doc_id") -> LineIndex:
        return cls._of(stored(reference_counts(docs, text, key)), min_docs)

    @classmethod
    def _of(cls, refs: DataFrame, min_docs: int) -> LineIndex:
        droppable = refs.filter(F.col("refs") >= min_docs)
        n = droppable.count()
        shards = 1 << max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
        return cls(refs, stored(_revised(None, droppable.withColumn("change", F.lit(0)), shards)), shards, min_docs, n)

    def insert(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineIndex:
        return self._changed(reference_counts(docs, text, key))

    def delete(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineIndex:
        """Undo the insertion of ``docs``."""
        return self._changed(reference_counts(docs, text, key).withColumn("refs", -F.col("refs")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        old = self.refs.select("hi", "lo", F.col("refs").alias("was"), F.lit(0).cast("long").alias("add"))
        new = delta.select("hi", "lo", F.lit(0).cast("long").alias("was"), F.col("refs").alias("add"))
        both = old.unionByName(new).groupBy("hi", "lo").agg(F.sum("was").alias("was"), F.sum("add").alias("add"))
        both = stored(both.withColumn("refs", F.col("was") + F.col("add")))
        refs = both.filter("refs > 0").select("hi", "lo", "refs")
        now, before = F.col("refs") >= self.min_docs, F.col("was") >= self.min_docs
        known = both.filter(now | before).withColumn("change", now.cast("int") - before.cast("int"))
        n = known.filter("change >= 0").count()
        if n > 2 * SHARD * self.shards:
            return self._of(refs, self.min_docs)
        filters = stored(_revised(self.filters, known, self.shards))
        return LineIndex(refs, filters, self.shards, self.min_docs, n)

    def exact(self) -> DataFrame:
        return self.refs.filter(F.col("refs") >= self.min_docs).select("hi", "lo")

    def drop_lines(
        self, docs: DataFrame, text: str = "text", key: str = "doc_id", sent: int = SENT, keep: tuple[str, ...] = ()
    ) -> DataFrame:
        """(key, columns to keep, n_lines, n_dropped, kept) for every row: droppable lines go, the others stay as they are.

        A null or empty text is one empty line, and blank lines always stay.  Rows with equal keys are
        treated one by one.
        """
        if self.droppable <= sent:
            return self._drop_sent(docs, text, key, keep)
        return self._drop_joined(docs, text, key, keep)

    def _drop_sent(self, docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> DataFrame:
        """At most ``sent`` keys: filters and exact keys go to every task."""
        exact = self.exact().toArrow().sort_by([("hi", "ascending"), ("lo", "ascending")])
        held = np.rec.fromarrays([exact.column(c).to_numpy() for c in ("hi", "lo")], names="hi,lo")
        cells = {r.shard: (r.buckets, bytes(r.cells)) for r in self.filters.collect()}
        shared = docs.sparkSession.sparkContext.broadcast((set(zip(held.hi.tolist(), held.lo.tolist())), cells))
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact, packed = shared.value
            filters = {s: _unpacked(*c) for s, c in packed.items()}
            for batch in small(batches):
                yield from _dropped(batch, (key, *keep), text, lambda found: _known(found, filters, shards, exact))

        return texts(docs, key, text, keep).mapInArrow(run, _result(docs, key, *keep))

    def _drop_joined(self, docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> DataFrame:
        """Any number of keys: the lines go to the exact table's rows, the droppable ones back to their texts."""
        kind = docs.schema[key].dataType.simpleString()
        rows = texts(docs, key, text, keep).withColumn("digest", F.xxhash64(text))

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                for i, one in enumerate(batch.column(text).to_pylist()):
                    found = set(line_keys(one))
                    found.discard(b"")
                    halves = digests(list(found))
                    own = batch.slice(i, 1)
                    again = pa.array(np.zeros(len(halves), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(key).take(again), own.column("digest").take(again),
                         *_halves(halves, again, ["a", "b", "c"]).columns[:2]],
                        [key, "digest", "hi", "lo"],
                    )

        pairs = rows.select(key, text, "digest").mapInArrow(lines, f"{key} {kind}, digest long, hi long, lo long")
        exact = self.exact().hint("merge")
        held = pairs.join(exact, ["hi", "lo"]).groupBy(key, "digest").agg(
            F.collect_set(F.struct("hi", "lo")).alias("held")
        )
        held = held.withColumnsRenamed({key: "_key", "digest": "_digest"})
        met = rows.hint("merge").join(held, rows[key].eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                sets = [{(x["hi"], x["lo"]) for x in one or ()} for one in batch.column("held").to_pylist()]
                each = iter(sets)
                yield from _dropped(batch, (key, *keep), text, lambda found: _member(found, next(each)))

        return met.select(key, text, *keep, "held").mapInArrow(run, _result(docs, key, *keep))


def _member(found: np.ndarray, exact: set) -> np.ndarray:
    return np.fromiter((pair in exact for pair in map(tuple, found.tolist())), bool, len(found))


def _known(found: np.ndarray, filters: dict, shards: int, exact: set) -> np.ndarray:
    """Whether each key is droppable: the filter of its shard first, then the exact keys."""
    hi, lo = np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])
    shard = hi & shards - 1
    maybe = np.zeros(len(found), bool)
    for s in np.unique(shard).tolist() if shards > 1 else [0]:
        if s in filters:
            own = shard == s
            maybe[own] = filters[s].has(hi[own], lo[own])
    maybe[maybe] = _member(found[maybe], exact)
    return maybe


def _dropped(batch: pa.RecordBatch, keep: tuple[str, ...], text: str, known) -> Iterator[pa.RecordBatch]:
    n_lines, n_dropped, kept = [], [], []
    for one in batch.column(text).to_pylist():
        keys = line_keys(one)
        gone = known(digests(keys))
        gone &= np.fromiter(map(bool, keys), bool, len(keys))
        n_lines.append(len(keys))
        n_dropped.append(int(gone.sum()))
        if n_dropped[-1]:
            one = "\n".join(line for line, out in zip(one.split("\n"), gone.tolist()) if not out)
        kept.append(one)
    yield pa.RecordBatch.from_arrays(
        [*map(batch.column, keep), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
         pa.array(kept, pa.string())],
        [*keep, "n_lines", "n_dropped", "kept"],
    )


def _result(docs: DataFrame, *keep: str) -> str:
    return f"{fields(docs, *keep)}n_lines long, n_dropped long, kept string"


def _unpacked(buckets: int, cells: bytes) -> CuckooFilter:
    return CuckooFilter(buckets, np.frombuffer(cells, np.uint16).reshape(buckets, -1).copy())


def _revised(filters: DataFrame | None, known: DataFrame, shards: int) -> DataFrame:
    """Filters after the changes: ``change`` is 1 for keys that enter, -1 for keys that leave, 0 for the rest.

    A shard has SHARD keys on average and at most a few times that; a filter without room is built anew.
    """

    def revise(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        now = keys[keys.change >= 0]
        part = lambda f: (f.hi.to_numpy(np.int64), f.lo.to_numpy(np.int64))
        fits = False
        if len(old):
            own = _unpacked(int(old.buckets[0]), old.cells[0])
            own.delete(*part(keys[keys.change < 0]))
            fits = own.insert(*part(keys[keys.change > 0]))
        room = max(1, len(now))
        while not fits:
            own = CuckooFilter.sized(room)
            fits = own.insert(*part(now))
            room *= 2
        shard = int((old if len(old) else keys).shard.iloc[0])
        return pd.DataFrame({"shard": [shard], "buckets": [own.buckets], "cells": [own.cells.tobytes()]})

    schema = "shard long, buckets long, cells binary"
    keyed = known.select(F.col("hi").bitwiseAND(F.lit(shards - 1)).alias("shard"), "hi", "lo", "change")
    if filters is None:
        filters = known.sparkSession.createDataFrame([], schema)
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(revise, schema)


#: Keys in at least so many documents lose their lines.
MIN_DOCS = 10


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(
      trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
gone AS (SELECT k, true AS drops FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE drops IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (k) GROUP BY doc_id
"""


@query("op4_line_dedup", SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten documents hold."""
    docs = table(spark, sf_dir, "documents")
    kept = LineIndex.build(docs, MIN_DOCS).drop_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
