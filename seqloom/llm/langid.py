"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass: a task adds up its texts' n-grams per language and hands over one row for each
language and bucket.  The log-probabilities are a matrix of languages times buckets, bounded by the two
parameters, and are broadcast.  Scoring reads the matrix rows of a text's n-grams only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import fields, id_remainder, query, small, table, texts

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Characters that are hashed together; a longer text is taken in slices of this length.
SLICE = 1 << 21


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log-probability of each language
    table: np.ndarray  # languages x buckets, log-probabilities
    sizes: tuple[int, ...]


def code_points(text: str) -> np.ndarray:
    """Lower-case letters and marks, every other stretch one space, a space at both ends."""
    plain = " " + OTHER.sub(" ", text.lower()).strip(" ") + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_buckets(points: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """The bucket of each stretch of ``size`` code points (``buckets`` is a power of two)."""
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, 0x9E3779B1 * size & 0xFFFFFFFF, np.uint32)
    for i in range(size):
        h ^= points[i : i + n]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def slices(points: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, int]]:
    """(slice, n-gram size) pairs that hold every n-gram of the text once."""
    for size in sizes:
        for start in range(0, max(1, len(points) - size + 1), SLICE):
            yield points[start : start + SLICE + size - 1], size


def fit(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    sizes: tuple[int, ...] = (2, 3),
    buckets: int = 1 << 14,
    max_languages: int = 256,
) -> Model:
    """Learn from every row that has a label and a letter.

    Null, empty and letterless texts teach nothing.  More than ``max_languages`` labels is an error,
    so that the broadcast matrix stays below max_languages * buckets * 8 bytes (32 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in small(batches):
            for one, name in zip(batch.column(text).to_pylist(), batch.column(label).to_pylist()):
                if not LETTER.search(one):
                    continue
                total = counts.setdefault(name, np.zeros(buckets, np.int64))
                seen[name] = seen.get(name, 0) + 1
                if len(seen) > max_languages:
                    raise ValueError(f"more than {max_languages} languages")
                for part, size in slices(code_points(one), sizes):
                    total += np.bincount(ngram_buckets(part, size, buckets), minlength=buckets)
        for name, total in counts.items():
            full = np.flatnonzero(total)
            where, n = np.append(full, -1), np.append(total[full], seen[name])
            names = pa.array([name] * len(where), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(where, pa.int32()), pa.array(n, pa.int64())], ["language", "bucket", "n"]
            )

    rows = docs.filter(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("string").alias(label)
    )
    counted = rows.mapInArrow(run, "language string, bucket int, n long")
    counted = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in counted.filter("bucket = -1").select("language").limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(names)
    place = {name: i for i, name in enumerate(languages)}
    counts, prior = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    for name, bucket, n in counted.collect():  # at most max_languages * (buckets + 1) rows
        if bucket < 0:
            prior[place[name]] = n
        else:
            counts[place[name], bucket] = n
    if languages:
        counts = np.log(counts + 0.5) - np.log(counts.sum(1, keepdims=True) + 0.5 * buckets)
        prior = np.log(prior) - np.log(prior.sum())
    return Model(languages, prior, counts, sizes)


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, columns to keep, lang_pred, score): the likeliest language and its posterior probability.

    A null, empty or letterless text is ``und`` with score 0; so is every text if nothing was learned.
    Equal likelihoods go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by max_languages * buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        buckets = m.table.shape[1]
        for batch in small(batches):
            names, scores = [], []
            for one in batch.column(text).to_pylist():
                if not m.languages or not LETTER.search(one):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = m.prior.copy()
                for part, size in slices(code_points(one), m.sizes):
                    n = np.bincount(ngram_buckets(part, size, buckets))
                    full = np.flatnonzero(n)
                    total += m.table[:, full] @ n[full]
                best = int(np.argmax(total))
                names.append(m.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, (key, *keep)), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [key, *keep, "lang_pred", "score"],
            )

    schema = f"{fields(docs, key, *keep)}lang_pred string, score double"
    return texts(docs, key, text, keep).mapInArrow(run, schema)


#: Documents whose remainder is HELD_OUT are not learned from.
FOLDS, HELD_OUT = 3, 1


def learned(docs: DataFrame) -> Model:
    return fit(docs.filter(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learned(docs))
    return found.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
