import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fixtures import as_dict, documents
from seqloom.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, length=10):
    windows = {}
    for name, text in items:
        found = plain(text)
        for i in range(max(1, len(found) - length + 1) if found else 0):
            windows.setdefault(tuple(found[i : i + length]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        found, hit, names = plain(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                owners = windows.get(tuple(found[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    names |= owners
        out.append((doc_id, len(found), len(hit), sorted(names)))
    return sorted(out, key=str)


def rows_of(df):
    got = []
    for r in df.collect():
        got.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r.items)))
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(got, key=str)


def made(dice, n):
    return " ".join(dice.choice("The a of Ünd x1 run, stop. -go-".split()) for _ in range(n))


@pytest.mark.parametrize("block,segment,together", [(8 << 20, 1 << 20, 1 << 20), (60, 200, 3)])
def test_agrees_with_brute_force(spark, monkeypatch, block, segment, together):
    monkeypatch.setattr(dc, "BLOCK", block)
    monkeypatch.setattr(dc, "SEGMENT", segment)
    monkeypatch.setattr(dc, "TOGETHER", together)
    dice = random.Random(3)
    items = [(i, made(dice, n)) for i, n in enumerate([12, 30, 4, 1, 0, 10, 18])] + [(7, None), (8, "the a of"), (1, "x1")]
    docs = [(i, made(dice, dice.choice([0, 3, 9, 40, 200]))) for i in range(25)]
    docs += [(100 + i, made(dice, 5) + " " + items[i % 2][1] + " " + made(dice, 3)) for i in range(6)]
    docs += [(200, None), (201, ""), (3, docs[3][1]), (3, docs[3][1]), (202, items[1][1] * 300), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(documents(spark, docs).withColumn("spans", F.lit(1)), bench)
    assert rows_of(got) == brute(docs, items)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = documents(spark, [(1, "one two x three four five"), (2, "one two three four five"), (3, "one two three"),
                             (4, "one x x x x two three four five"), (5, "two one three five four")])
    got = as_dict(dc.find_leaks(docs, bench, length=5, slop=2))
    assert {k: list(r.near_items) for k, r in got.items()} == {1: ["1"], 2: ["1"], 3: [], 4: [], 5: ["1"]}
    assert {k for k, r in got.items() if r["items"]} == {2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "one two"), (2, None)])
    assert rows_of(dc.find_leaks(docs, none)) == [(1, 2, 0, []), (2, 0, 0, [])]
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert dc.find_leaks(documents(spark, []), some).count() == 0


def test_the_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = as_dict(dc.op3_decontaminate(spark, folder))
    want = brute(docs, items)
    assert len(got) == len(want)
    for doc_id, n_words, n_hit, names in want:
        row = got[doc_id]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n_words, n_hit, len(names), n_hit > 0)
        assert row.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
