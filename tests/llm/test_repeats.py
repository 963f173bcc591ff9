import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents
from seqloom.llm import repeats


def brute(rows, depth):
    """Rows that repeat a key and its text are one document."""
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        key, raw = rows[i][0], (rows[i][1] or "").encode()
        for s in range(len(raw) - depth + 1):
            at = (key is None, key or 0, s)
            first[raw[s : s + depth]] = min(first.get(raw[s : s + depth], at), at)
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - depth + 1):
            if first[raw[s : s + depth]] < (key is None, key or 0, s):
                gone[s : s + depth] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def some(seed, n, depth):
    dice = random.Random(seed)
    passages = ["".join(dice.choice("abcdé ") for _ in range(dice.randrange(depth - 5, 3 * depth))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(dice.randrange(0, 5)):
            part = dice.choice(passages)
            if dice.random() < 0.4:
                part = part[dice.randrange(len(part)) :]
            if dice.random() < 0.3 and part:
                at = dice.randrange(len(part))
                part = part[:at] + "X" + part[at + 1 :]
            text += part + "".join(dice.choice("xyz") for _ in range(dice.randrange(0, depth)))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed,together,held", [(1, 1 << 21, 1 << 18), (2, 150, 20)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, together, held):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "SORTED", held)
    depth = 40
    rows = some(seed, 60, depth)
    rows += [(500, None), (501, ""), (502, "q" * 39), (503, "q" * 300), (504, "qr" * 200), (505, rows[3][1] + "!" + rows[3][1]),
             (506, rows[7][1]), (507, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (508, "日本語" * 60), (-5, rows[11][1])]
    random.Random(seed).shuffle(rows)
    docs = documents(spark, rows).withColumn("doc", F.lit("z")).withColumn("tag", F.lit(1)).repartition(6)
    assert found(repeats.remove_repeats(docs, depth, 12)) == brute(rows, depth)


def test_the_joined_way_and_the_whole_depth(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SENT", -1)
    rows = some(5, 40, 100)
    assert found(repeats.remove_repeats(documents(spark, rows).repartition(5))) == brute(rows, 100)


def test_empty_tables(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    rows = [(1, None), (2, "short"), (2, "short")]
    assert found(repeats.remove_repeats(documents(spark, rows))) == brute(rows, 100)


def test_longest_previous_factors():
    """Against the definition, on all suffixes of one text as one group."""
    dice = random.Random(2)
    for _ in range(30):
        text = "".join(dice.choice("ab") for _ in range(60)).encode() + b"\0" * 16
        depth = 8
        words = np.array([[int.from_bytes(text[i : i + depth], "big")] for i in range(60)], np.uint64)
        position = np.array(dice.sample(range(60), 60))
        got = repeats.has_longer_previous(np.zeros(60, int), words, position)
        for i in range(60):
            assert got[i] == any(position[j] < position[i] and text[j : j + depth] == text[i : i + depth] for j in range(60))


def test_many_different_strings_with_large_positions():
    """Every string occurs twice; distinct strings times positions exceed 64 bits."""
    n = 3000
    words = np.tile(np.arange(n, dtype=np.uint64), 2)[:, None]
    position = np.arange(2 * n) * (1 << 42)
    got = repeats.has_longer_previous(np.zeros(2 * n, int), words, position)
    assert got.tolist() == [False] * n + [True] * n


def test_frequent_anchors_are_not_sorted_in_one_task(spark, monkeypatch):
    """One passage in many contexts: no call puts more strings in order than its bound, and no repeat is lost."""
    dice = random.Random(4)
    passage = "".join(dice.choice("abcdefgh") for _ in range(50))
    rows = [(i, "".join(dice.choice("xyz") for _ in range(40)) + passage + "".join(dice.choice("xyz") for _ in range(40))) for i in range(60)]
    rows += [(100 + i, rows[i][1][5:100] + "!" * i) for i in range(30)]
    docs = documents(spark, rows).repartition(4)
    want = brute(rows, 40)
    monkeypatch.setattr(repeats, "SORTED", 64)

    def bounded(held, depth, resolve=repeats.resolve):
        strings = Counter()
        for r in held:
            strings[r[0]] += r[4] - r[5] + 1
        assert max(strings.values()) <= 64 and sum(strings.values()) < 128
        return resolve(held, depth)

    monkeypatch.setattr(repeats, "resolve", bounded)
    assert found(repeats.remove_repeats(docs, 40, 12)) == want


def test_anchors_hold_every_string_once():
    dice = random.Random(1)
    parts = ["".join(dice.choice("abc") for _ in range(n)).encode() for n in (0, 39, 40, 200, 1000)] + [b"a" * 500]
    part, place, far, near, _, _ = repeats.Anchors(40, 12).of(parts)
    seen = sorted((p, a - o) for p, a, f, n in zip(part, place, far, near) for o in range(n, f + 1))
    assert seen == [(p, s) for p, raw in enumerate(parts) for s in range(len(raw) - 39)]
    assert ((near >= 0) & (far <= 28)).all()


def test_the_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(repeats.op10_repeats(spark, folder)) == brute(rows, 100)
