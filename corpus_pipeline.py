"""A corpus, from raw documents to tokens: five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of ``documents``; other columns are dropped.  A null text is an empty
text.  Rows with equal keys and equal texts are one document to the join of near copies, and rows of their own elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, jaccard, langid, linededup
from seqloom.llm.common import Scratch, table, with_size_check

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = COLUMNS[2:4]
#: A language with a smaller posterior probability is not accepted.
LEAST_SCORE = 0.5
#: Up to so many rows to drop are sent to all tasks; beyond that they are joined.
SENT = 1 << 21


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *COLUMNS[2:])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is recognised; those without a letter, or too uncertain, go.

    If no row has a language to learn from, nothing is recognised and nothing can be told: all rows with a letter stay.
    """
    rows = _own(docs)
    model = langid.learned(rows)
    if not model.languages:
        return rows.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(rows, model, keep=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents hold; n_chars is that of the text that stays."""
    rows = _own(docs)
    kept = linededup.LineIndex.build(rows, linededup.MIN_DOCS).drop_lines(rows, keep=OTHERS)
    n = F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select("doc_id", F.col("kept").alias("text"), *OTHERS, n)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest key, a null key being the largest.

    Texts without words are copies of nothing and stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    rows = _own(docs).withColumn("key", key)
    scratch = Scratch(spark)
    found = scratch.keep(jaccard.link(rows, key="key"))
    copies = found.filter((F.col("key") != F.col("component_id")) & (F.col("n_shingles") > 0)).select("key").distinct()
    kept = with_size_check(rows, copies, ["key"], "left_anti", SENT)
    twice = found.filter("n_shingles > 0").groupBy("key").count().filter("count > 1").select("key")
    if not twice.isEmpty():  # rows that repeat key and text
        repeated = with_size_check(kept, twice, ["key"], "left_semi", SENT).dropDuplicates(["key"])
        kept = with_size_check(kept, twice, ["key"], "left_anti", SENT).unionByName(repeated)
    return kept.select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    rows = _own(docs).withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    found = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), key="key")
    leaks = Scratch(spark).keep(found.filter(F.size("spans") > 0).select("key").distinct())
    return with_size_check(rows, leaks, ["key"], "left_anti", SENT).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and digests of them and of the bytes they decode to."""
    return bpe.round_trip(_own(docs), keep=OTHERS)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmarks", benchmarks),
    ("tokens", tokens),
]

#: SQL has no way to say the learned language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
