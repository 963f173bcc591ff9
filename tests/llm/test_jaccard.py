import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents
from seqloom.llm import hashing, jaccard
from seqloom.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def shingles(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c not in SPACE else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys, default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_copies(seed, bases, copies, words):
    dice = random.Random(seed)
    texts = []
    for b in range(bases):
        base = [f"w{dice.randrange(400)}" for _ in range(dice.randrange(*words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(dice.randrange(0, 1 + len(own) // 25)):
                own[dice.randrange(len(own))] = f"n{dice.randrange(1000)}"
            if dice.random() < 0.3:
                own += [f"e{dice.randrange(50)}" for _ in range(dice.randrange(len(own) // 3 + 1))]
            if dice.random() < 0.2:
                own = own[: int(len(own) * dice.uniform(0.6, 1.0))]
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    texts = near_copies(seed, 6, 25, (20, 160)) + near_copies(seed + 10, 3, 10, (5, 9))
    dice = random.Random(seed)
    dice.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  TWO\n"), (905, "two one"), (906, "é É"),
             (907, "x " * 3000), (908, "x x x x x"), (909, "x x x x"), (5, texts[0]), (5, texts[0]), (None, texts[1]),
             (None, "lonely row without a key"), (910, "y" * 50_000)]
    docs = documents(spark, rows).withColumn("id", F.lit(1)).withColumn("component_id", F.lit("x")).repartition(7)
    assert found(jaccard.link(docs)) == brute(rows)


def test_a_large_group_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT", -1)
    dice = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):  # near copies of one text
        own = list(base)
        own[dice.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(1000 + i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(5 + i % 9))) for i in range(60)]
    assert found(jaccard.link(documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert jaccard.link(documents(spark, [])).count() == 0
    assert found(jaccard.link(documents(spark, [(1, None), (2, "a b")]))) == [(1, 0, 1), (2, 1, 2)]


def test_the_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = [shingles(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for one in s:
            by.setdefault(one, []).append(i)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for one in s:
            for j in by[one]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    want = sorted(((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)), key=str)
    assert found(jaccard.op6_ngram_join(spark, folder)) == want


def test_pieces_hash_as_wholes(monkeypatch):
    texts = ["Some words HERE", "", "and  more\twords", "x" * 500, "some words here"]
    whole = hashing.WordHasher().words(texts)
    monkeypatch.setattr(hashing, "PIECE", 7)
    parts = hashing.WordHasher().words(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(set(whole[0].tolist())) == 6 and whole[1].tolist() == [0, 3, 3, 6, 7, 10]


def test_suffix_filter_loses_nothing():
    dice = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(dice.integers(0, 2**64, dice.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.append(a[dice.random(len(a)) < dice.choice([0.7, 0.9, 1.0])], dice.integers(0, 2**64, 3, dtype=np.uint64)))
        both = len(set(a.tolist()) & set(b.tolist()))
        assert jaccard.similar(a, b, 75) == (100 * both >= 75 * (len(a) + len(b) - both))


@pytest.mark.parametrize("together", [1 << 19, 100])
def test_components(spark, monkeypatch, together):
    monkeypatch.setattr("seqloom.llm.components.LINKS", together)
    dice = random.Random(1)
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (7, 7)]
    links += [(dice.randrange(2000, 2300), dice.randrange(2000, 2300)) for _ in range(160)]
    dice.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    group = {}

    def root(i):
        while group.setdefault(i, i) != i:
            i = group[i]
        return i

    for a, b in links:
        if a != b:
            group[root(a)] = root(b)
    nodes = set(group)
    assert {r.node for r in got} == nodes and len(got) == len(nodes)
    same = {}
    for r in got:
        same.setdefault(r.root, set()).add(root(r.node))
    assert all(len(s) == 1 for s in same.values()) and len(same) == len({root(n) for n in nodes})
