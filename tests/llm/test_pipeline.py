import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_bpe
import test_decontaminate
import test_jaccard
import test_linededup
from fixtures import documents
from seqloom.llm import langid

library = test_bpe.library


def brute(rows, predicted, items, encode, min_docs=10):
    """rows: (doc_id, text); predicted: (language, score) of each."""
    rows = [(k, t or "") for (k, t), (lang, score) in zip(rows, predicted) if lang != "und" and score >= 0.5]
    order = {}
    for k, _, _, kept in test_linededup.brute([(i, t) for i, (_, t) in enumerate(rows)], min_docs):
        order[k] = kept
    rows = [(rows[i][0], order[i]) for i in range(len(rows))]
    # one document of each group: the smallest key, then any of its rows
    sets = [test_jaccard.shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        rank = (k is None, k or 0)
        if sets[i] and (root(i) not in best or rank < best[root(i)][0]):
            best[root(i)] = (rank, i)
    stay = {i for _, i in best.values()}
    rows = [r for i, r in enumerate(rows) if not sets[i] or i in stay]
    clean = [n for _, _, n, _ in test_decontaminate.brute([(i, t) for i, (_, t) in enumerate(rows)], items)]
    hits = {i: n for i, _, n, _ in test_decontaminate.brute([(i, t) for i, (_, t) in enumerate(rows)], items)}
    rows = [r for i, r in enumerate(rows) if not hits[i]]
    assert len(clean) >= len(rows)
    return sorted(
        ((k, len(ids := encode(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
          hashlib.sha256(t.encode()).hexdigest()) for k, t in rows), key=str)


def predictions(spark, rows):
    docs = documents(spark, rows)
    model = langid.learned(docs)
    found = {}
    for r in langid.predict(docs.withColumn("n", F.monotonically_increasing_id()).coalesce(1).withColumn("doc_id", F.col("n")), model).collect():
        found[r.doc_id] = (r.lang_pred, r.score)
    return [found[i] for i in sorted(found)]


def results(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_agrees_with_brute_force(spark, library, tmp_path):
    dice = random.Random(8)
    english, german = "the of and is in cat dog house runs over".split(), "der die und ist das katze hund haus über auf".split()

    def made(words, n):
        return " ".join(dice.choice(words) + str(dice.randrange(30)) for _ in range(n))

    items = [(1, made(english, 14)), (2, "ein zwei"), (3, None)]
    rows = []
    for i in range(40):
        words, lang = (english, "en") if i % 2 else (german, "de")
        text = made(words, dice.randrange(20, 60))
        rows.append((i, text + ("\nshared LINE here" if i < 25 else "") + "\n" + made(words, 8), lang))
        if i % 4 == 0:
            rows.append((100 + i, rows[-1][1].replace(" ", "  ", 1), lang))  # a near copy
        if i % 9 == 0:
            rows.append((200 + i, rows[-1][1] + " " + items[0][1], lang))
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34", None), (303, "shared line here", "en"), (304, "ein  Zwei drei", "de"),
             (5, rows[5][1], "en"), (5, rows[5][1], "en"), (None, made(english, 30), "en"), (None, rows[0][1], "de")]
    pairs = [r[:2] for r in rows]
    docs = documents(spark, rows).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(pairs, predictions(spark, rows), items, library.encode_ordinary)
    assert results(corpus_pipeline.run(spark, str(tmp_path))) == want
    assert 10 < len(want) < len(rows) - 10


def test_stages_return_the_columns_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs.withColumn("keep", F.lit(1)), folder).dtypes) == dict(docs.dtypes), name


@pytest.mark.parametrize("number", range(5))
def test_empty_tables(spark, number):
    docs = documents(spark, [])
    assert corpus_pipeline.STAGES[number][1](spark, docs, "/root/testdata/sf0.001").count() == 0


def test_the_query_agrees_with_brute_force(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([r[:2] for r in rows], predictions(spark, rows), items, library.encode_ordinary)
    assert results(corpus_pipeline.run(spark, folder)) == want
