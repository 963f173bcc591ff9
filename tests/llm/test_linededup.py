import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents
from seqloom.llm import linededup as ld

SPACE = " \t\n\x0b\x0c\r"
LINES = ["Alpha", " alpha\t", "ALPHA\r", "beta", "gamma é", "Gamma É", "", "  ", "delta", "x" * 9000, "alpha"]


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some(seed, n):
    dice = random.Random(seed)
    rows = [(i, "\n".join(dice.choice(LINES) for _ in range(dice.randrange(1, 6)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, "\n"), (3, rows[3][1]), (3, rows[3][1]), (None, "beta\nend"), (None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sent", [ld.SENT, 0])
def test_agrees_with_brute_force(spark, sent):
    rows = some(1, 30)
    docs = documents(spark, rows).withColumn("kept", F.lit("x")).withColumn("hi", F.lit(1))
    index = ld.LineIndex.build(docs, 8)
    assert rows_of(index.drop_lines(docs, sent=sent)) == brute(rows, 8)


def test_insertions_and_deletions_are_reversible(spark):
    first, second, third = some(1, 30), some(2, 25), some(3, 40)
    a, b, c = (documents(spark, r) for r in (first, second, third))
    index = ld.LineIndex.build(a, 8).insert(b).insert(c).delete(b)
    again = ld.LineIndex.build(a.unionByName(c), 8)
    assert rows_of(index.refs) == rows_of(again.refs)
    assert sorted(rows_of(index.drop_lines(a)) + rows_of(index.drop_lines(c)), key=str) == brute(first + third, 8)
    assert rows_of(index.drop_lines(c)) == rows_of(again.drop_lines(c))
    back = index.delete(c)
    assert rows_of(back.refs) == rows_of(ld.LineIndex.build(a, 8).refs)
    assert rows_of(back.drop_lines(a)) == brute(first, 8)
    assert back.delete(a).refs.count() == 0


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD", 4)
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 3, 60))) for i in range(20)]
    docs = documents(spark, rows)
    index = ld.LineIndex.build(docs, 8)
    assert index.shards >= 8 and rows_of(index.drop_lines(docs)) == brute(rows, 8)


def test_cuckoo_filter():
    dice = np.random.default_rng(4)
    keys = dice.integers(-(2**63), 2**63 - 1, (5000, 2))
    f = ld.CuckooFilter.sized(3000)
    assert f.insert(keys[:3000, 0].copy(), keys[:3000, 1].copy())
    assert f.has(keys[:3000, 0].copy(), keys[:3000, 1].copy()).all()
    assert f.has(keys[3000:, 0].copy(), keys[3000:, 1].copy()).mean() < 0.01
    f.delete(keys[:1500, 0].copy(), keys[:1500, 1].copy())
    assert f.has(keys[1500:3000, 0].copy(), keys[1500:3000, 1].copy()).all()
    assert f.has(keys[:1500, 0].copy(), keys[:1500, 1].copy()).mean() < 0.01
    small = ld.CuckooFilter(4)
    assert not small.insert(keys[:100, 0].copy(), keys[:100, 1].copy())


def test_empty_table(spark):
    docs = documents(spark, [])
    assert ld.LineIndex.build(docs).drop_lines(docs).count() == 0
