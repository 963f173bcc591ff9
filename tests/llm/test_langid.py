import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fixtures import as_dict, documents
from seqloom.llm import langid

TRAIN = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]


def brute(model, text):
    totals = model.prior.copy()
    points = langid.code_points(text)
    for size in model.sizes:
        for bucket, n in Counter(langid.ngram_buckets(points, size, model.table.shape[1]).tolist()).items():
            totals += n * model.table[:, bucket]
    best = int(np.argmax(totals))
    return model.languages[best], 1 / sum(math.exp(t - totals[best]) for t in totals)


def test_counts_and_scores_agree_with_brute_force(spark, monkeypatch):
    docs = documents(spark, TRAIN)
    model = langid.fit(docs)
    want = {"en": Counter(), "de": Counter()}
    for _, text, lang in TRAIN:
        for size in model.sizes:
            want[lang].update(langid.ngram_buckets(langid.code_points(text), size, 1 << 14).tolist())
    for i, lang in enumerate(model.languages):
        total = sum(want[lang].values())
        for bucket, n in want[lang].items():
            assert math.isclose(model.table[i, bucket], math.log((n + 0.5) / (total + 0.5 * (1 << 14))))
    asked = [(1, "the hound"), (2, "der kater und"), (3, "x"), (4, "hund and dog die katze the cat")]
    for row in langid.predict(documents(spark, asked), model).collect():
        lang, score = brute(model, dict(asked)[row.doc_id])
        assert row.lang_pred == lang and math.isclose(row.score, score, rel_tol=1e-9)


def test_slices_hold_every_ngram_once(monkeypatch):
    points = langid.code_points("abc def ghij" * 50)
    whole = {n: langid.ngram_buckets(points, n, 1 << 14).tolist() for n in (2, 3)}
    monkeypatch.setattr(langid, "SLICE", 37)
    for n in (2, 3):
        parts = [langid.ngram_buckets(p, size, 1 << 14).tolist() for p, size in langid.slices(points, (n,))]
        assert sum(parts, []) == whole[n]


def test_edge_rows(spark):
    model = langid.fit(documents(spark, TRAIN + [(99, None, "en"), (98, "12 !", "xx"), (97, "le chat", None)]))
    assert model.languages == ["de", "en"]  # texts without letters and rows without a label teach nothing
    rows = [(1, None), (2, ""), (3, "123 --"), (4, "the dog " * 200_000), (4, "the dog"), (None, "katze und hund")]
    docs = documents(spark, rows).withColumn("lang_pred", F.lit("zz")).withColumn("score", F.lit(7.0))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.lang_pred == "und") == (row.doc_id in (1, 2, 3))
        assert 0.0 <= row.score <= 1.0
    empty = langid.fit(documents(spark, []))
    assert langid.predict(documents(spark, rows), empty).select("lang_pred").distinct().first()[0] == "und"
    assert langid.predict(documents(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = as_dict(langid.op8_language_id(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert all(got[d.doc_id].held_out for d in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97
