"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their n-grams.

Separators collapse to single spaces, and one regular expression, applied with overlaps and bounded by look-arounds, finds at
every word the longest run of up to three words that begins there.  Its words end at spaces, so it holds the
spans of the one-, two- and three-word features, whose CRCs continue each other.  Buckets of CRCs are counted
over all documents and over the target; a document's weight is the sum of its buckets' gains, and Gumbel noise by key turns
the largest scores into a draw without replacement.

Every text is scanned once: a document's buckets are stored, counted, and weighed when the gains are known.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, fields, query, small, sum_vectors, table, texts
from seqloom.operators.ordinal import row_ordinals

#: Buckets of feature hashes, words of the longest feature.
BUCKETS, WORDS = 10_000, 3
#: Percent of the documents of LEAST words or more that are drawn.
PERCENT, LEAST = 5, 20
SEED = "42"
#: Bytes that are scanned together.
PIECE = 1 << 20
#: Buckets of totals that travel in one part.
PART = 1 << 16

_LOWER = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
_GAPS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RUN = regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){0,%d}+(?![^ ])" % (WORDS - 1))


def collapsed(text: str) -> bytes:
    """The words in lower case (A-Z only), with single spaces between them."""
    return _GAPS.sub(b" ", text.encode("utf-8").translate(_LOWER)).strip(b" ")


def runs(data: bytes) -> Iterator[list[bytes]]:
    """For every word the longest run that begins there; long texts in pieces that overlap by what a run needs."""
    start = 0
    while start < len(data):
        cut = data.find(b" ", start + PIECE)
        if cut < 0:
            yield _RUN.findall(data, start, overlapped=True)
            return
        end, extra = cut, 0
        while extra < WORDS - 1 and end < len(data):
            end = data.find(b" ", end + 1)
            end = len(data) if end < 0 else end
            extra += 1
        found = _RUN.findall(data, start, end, overlapped=True)
        yield found[: len(found) - extra]
        start = cut + 1


def features(text: str) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature."""
    crc, n, parts = zlib.crc32, 0, [np.empty(0, np.uint16)]
    for found in runs(collapsed(text)):
        codes: list[int] = []
        add = codes.append
        for run in found:
            code, at = 0, 0
            while (end := run.find(b" ", at + 1)) >= 0:
                code = crc(run[at:end], code)
                add(code)
                at = end
            add(crc(run[at:], code))
        n += len(found)
        parts.append((np.array(codes, np.uint32) % BUCKETS).astype("<u2"))
    return n, np.concatenate(parts)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_features, buckets binary of little-endian unsigned 16-bit numbers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [features(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                 pa.array([b.tobytes() for _, b in found], pa.binary())],
                [key, "n_words", "n_features", "buckets"],
            )

    return texts(docs, key, text).mapInArrow(run, f"{fields(docs, key)}n_words long, n_features long, buckets binary")


def totals(scanned: DataFrame) -> np.ndarray:
    """How often every bucket occurs in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in small(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u2"), minlength=BUCKETS)
        parts = [zlib.compress(total[i : i + PART].tobytes(), 1) for i in range(0, BUCKETS, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "vector"])

    found = sum_vectors(scanned.select("buckets").mapInArrow(run, "part int, vector binary"), np.int64)
    return np.zeros(BUCKETS, np.int64) if found is None else found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = float(source.sum()), float(target.sum())
    ratios = ((float(b) + 1.0) * (s + BUCKETS) / ((float(a) + 1.0) * (t + BUCKETS)) for a, b in zip(source, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(key: Column) -> Column:
    """A thousand times Gumbel noise by the key, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least: int = LEAST,
) -> DataFrame:
    """(key, n_features, weight, score, rank): all rows, those that are drawn with their rank from 1.

    ``percent`` of the rows with ``least`` words or more are drawn, rounded down: the largest scores, ties to the
    smaller key, a null key first.  A null or empty text has no features and weight 0.  Rows of equal keys have
    equal noise and are drawn one by one.  Without rows, or without a target, the same formulas hold.  Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.keep(scan(docs, key, text))
    aim = target.select(F.lit(0).alias("item"), F.col(target_text).alias("text"))
    gain = docs.sparkSession.sparkContext.broadcast(gains(totals(scanned), totals(scan(aim, "item", "text"))))  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            weights = [int(gain.value[np.frombuffer(b, "<u2")].sum()) for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, (key, "n_words", "n_features")), pa.array(weights, pa.int64())],
                [key, "n_words", "n_features", "weight"],
            )

    weighed = scanned.mapInArrow(weigh, f"{fields(docs, key)}n_words long, n_features long, weight long")
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise(F.col(key))))
    scratch.drop(scanned)
    can = F.col("n_words") >= least
    drawn = percent * scored.filter(can).count() // 100
    # equal rows are told apart, so that any number of them spreads over the ranges
    rows = scored.withColumn("_down", -F.col("score")).withColumn("_row", F.monotonically_increasing_id())
    ranked = row_ordinals(rows.filter(can), [], ["_down", key, "_row"], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    rest = scored.filter(~can).withColumn("rank", F.lit(None).cast("long"))
    columns = [key, "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(rest.select(*columns, "rank"))


@query("op13_resampling")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
