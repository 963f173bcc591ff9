import json
import math
import random
import tracemalloc
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents
from seqloom.llm import lm
from seqloom.llm.common import Scratch


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w] + [None]


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def base(rows, training):
    counts = Counter(w for _, t in training for w in words(t))
    n, v = sum(counts.values()), len(counts)
    total = n + 0.5 * (v + 1)
    out = []
    for key, text in rows:
        found = words(text)
        out.append((key, len(found), sum(counts[w] > 0 for w in found), n,
                    sum(math.log10((counts[w] + 0.5) / total) for w in found)))
    return out


def some(seed, n):
    dice = random.Random(seed)
    return [(i, " ".join(dice.choice(["the", "of", "A", "b,", "Cc", f"w{dice.randrange(60)}"]) for _ in range(dice.randrange(0, 90))))
            for i in range(n)]


EDGE = [(500, None), (501, ""), (502, " \t"), (503, "unseen words é only"), (504, "the of " * 4000), (505, "z" * 5000),
        (3, "the the of"), (3, "the the of"), (None, "of a b, cc")]


def agree(got, want):
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("head,held", [(1 << 20, 1 << 22), (30, 300)])
def test_counts_and_base_scores(spark, monkeypatch, head, held):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "WORDS", 20)
    monkeypatch.setattr(lm, "IN_CLASS", 8)
    training, rows = some(1, 60), some(1, 60)[:20] + some(2, 20) + EDGE
    docs = documents(spark, rows).withColumn("words", F.lit(1)).withColumn("rid", F.lit(2)).repartition(3)
    got = lm.score(docs, documents(spark, training).repartition(4)).collect()
    agree([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], base(rows, training))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_are_those_of_one_step_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "WORDS", 20)
    monkeypatch.setattr(lm, "IN_CLASS", 8)
    training, rows = some(1, 60), some(2, 25) + EDGE
    scratch = Scratch(spark)
    counts = scratch.keep(lm.count_words(documents(spark, training), "doc_id", "text"))
    v, _ = lm.head_of(counts)
    flat = lm.train(documents(spark, training), v, scratch, "doc_id", "text")
    assert not np.array_equal(flat, lm.Network(v).flat)
    assert math.isclose(v.mass.sum(), v.total) and math.isclose(sum(lm.Network(v).word_bias[0].astype(float) > -60), 8)
    got = lm.score_head(documents(spark, rows).repartition(2), v, flat, "doc_id", "text").collect()
    want = {}
    net, hasher = lm.Network(v, flat), lm.WordHasher()
    end = v.code(np.array([lm.END], np.uint64))[0][0]
    for key, text in rows:
        hashes, _ = hasher.words([text or ""])
        codes, logs = v.code(np.append(hashes, np.uint64(lm.END)))
        h, before, total = np.zeros((1, lm.WIDTH), np.float32), end, 0.0
        for code, log in zip(codes, logs):
            h = net.run(np.array([[before]]), np.zeros((1, 1), bool), h)[0]
            logits = (h[0] @ net.to_class + net.class_bias).astype(float)
            own = int(net.class_of(np.array([code]))[0])
            total += logits[own] - math.log(np.exp(logits).sum())
            if code < v.words:
                logits = (h[0] @ net.to_word[own] + net.word_bias[own]).astype(float)
                total += logits[code % lm.IN_CLASS] - math.log(np.exp(logits).sum())
            else:
                total += (log - math.log10(v.mass[own])) * math.log(10)
            before = code
        want.setdefault(key, []).append(total / math.log(10))
    for row in got:
        assert min(abs(row.score - w) for w in want[row.doc_id]) < 1e-3 * max(1.0, abs(row.score))


def test_every_token_is_trained_on(spark, monkeypatch, tmp_path):
    """Over the rounds each document is laid out once, whole, so that its state runs from its beginning to its end."""
    def noted(lists, n, window=lm.WINDOW, lanes=lm.lanes, folder=str(tmp_path)):
        with open(f"{folder}/{uuid.uuid4()}", "w") as out:
            json.dump([x.tolist() for x in lists], out)
        return lanes(lists, n, window)

    rows = some(1, 40) + [(500, "the of a w1 " * 300), (501, ""), (502, None)]
    scratch = Scratch(spark)
    v, _ = lm.head_of(scratch.keep(lm.count_words(documents(spark, rows), "doc_id", "text")))
    monkeypatch.setattr(lm, "lanes", noted)
    lm.train(documents(spark, rows).repartition(3), v, scratch, "doc_id", "text")
    got = [x for file in tmp_path.iterdir() for x in json.loads(file.read_text())]
    hasher = lm.WordHasher()
    want = [v.code(np.append(hasher.words([t or ""])[0], np.uint64(lm.END)))[0].tolist() for _, t in rows]
    assert sorted(got) == sorted(want)


def test_gradients():
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0), 20, 2, np.ones(4), np.ones(20), 60, 20)
    dice = np.random.default_rng(0)
    net = lm.Network(v, dice.standard_normal(lm.Network(v).size) * 0.3)
    tell = dice.integers(0, 22, (5, 3)).astype(np.int32)
    read, first, start = np.roll(tell, 1, 0), dice.random((5, 3)) < 0.2, np.zeros((3, lm.WIDTH), np.float32)
    grads, keep = lm.Network(v, np.zeros(net.size)), []

    def loss(n):
        return -n.log_probabilities(n.run(read, first, start).reshape(-1, lm.WIDTH), tell.ravel())[0].astype(float).sum()

    states = net.run(read, first, start, keep)
    _, back = net.log_probabilities(states.reshape(-1, lm.WIDTH), tell.ravel(), grads)
    net.backward(read, first, keep, back.reshape(states.shape), grads)
    for name in ("inputs", "state", "to_class", "class_bias", "to_word", "word_bias"):
        where = np.argmax(np.abs(getattr(grads, name)))
        value = getattr(net, name).reshape(-1)
        old, step = value[where], 1e-2
        value[where] = old + step
        up = loss(net)
        value[where] = old - step
        down = loss(net)
        value[where] = old
        assert math.isclose((up - down) / (2 * step), getattr(grads, name).reshape(-1)[where], rel_tol=0.02, abs_tol=1e-3)


def small_vocabulary(words=40, bands=3, classes=5):
    return lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0), words, bands, np.ones(classes), np.ones(words), 60, 20)


def test_a_step_moves_what_has_gradients():
    """The inputs of words that were not read keep their place, and every value moves as in a step over all of them."""
    v = small_vocabulary()
    dice = np.random.default_rng(3)
    net = lm.Network(v, dice.standard_normal(lm.Network(v).size) * 0.3)
    read = np.array([0, 7, 42])
    grads = lm.Network(v, dice.standard_normal(net.size))
    grads.inputs[np.setdiff1d(np.arange(len(grads.inputs)), read)] = 0
    squares = np.full(net.size, 1e-6, np.float32)
    g = grads.flat / np.float32(9)
    sums = squares + g * g
    want = net.flat - lm.RATE * g / np.sqrt(sums)
    net.descend(grads, squares, read, 9)
    assert np.array_equal(net.flat, want) and np.array_equal(squares, sums) and not grads.flat.any()


def test_codes_are_those_of_a_search():
    dice = np.random.default_rng(5)
    crowd = np.uint64(1 << 63) + dice.integers(0, 1 << 20, 300).astype(np.uint64)  # all in one slot
    hashes = np.unique(np.concatenate([crowd, dice.integers(0, 1 << 64, 700, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    for known in (hashes, hashes[1:-1], hashes[:1], hashes[-1:]):
        codes, logs = dice.permutation(len(known)).astype(np.int32), dice.random(len(known))
        v = lm.Vocabulary(known, codes, logs, len(known), 0, np.ones(1), np.ones(1), 1, 1)
        found = np.concatenate([hashes, hashes + np.uint64(1), hashes - np.uint64(1), dice.integers(0, 1 << 64, 500, np.uint64)])
        where = {int(h): i for i, h in enumerate(known)}
        want = [(codes[where[int(h)]], logs[where[int(h)]]) if int(h) in where else (v.tail, 0.0) for h in found]
        code, log = v.code(found)
        assert [*zip(code.tolist(), log.tolist())] == want
        assert np.concatenate(v.code_lists([found[:9], found[9:9], found[9:]])).tolist() == code.tolist()


def test_outputs_of_many_rows_are_worked_out_a_few_at_a_time():
    """The softmax of all rows at once leaves a core's cache: 20,000 rows would take over 3 MB for each of its arrays."""
    v = small_vocabulary()
    dice = np.random.default_rng(2)
    net = lm.Network(v, dice.standard_normal(lm.Network(v).size) * 0.3)
    h, codes = dice.standard_normal((20_000, lm.WIDTH)).astype(np.float32), np.append(np.full(16_000, 3), dice.integers(0, 44, 4_000))
    net.log_probabilities(h[:2], codes[:2])
    tracemalloc.start()
    found, _ = net.log_probabilities(h, codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6
    assert np.allclose(found[::500], [net.log_probabilities(h[i : i + 1], codes[i : i + 1])[0][0] for i in range(0, 20_000, 500)], atol=1e-5)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert lm.score(none, none).count() == 0
    got = lm.score(documents(spark, [(1, "a b"), (2, None)]), none).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got)] == [(3, 0, 0), (1, 0, 0)]
    assert all(abs(r.base_score) < 1e-9 for r in got)
    assert lm.score(none, documents(spark, some(1, 5))).count() == 0


def test_the_query(spark):
    folder = "/root/testdata/sf0.01"
    got = lm.op5_lm_score(spark, folder).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    agree([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got],
          base(rows, [r for r in rows if not held_out(r[0])]))
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
