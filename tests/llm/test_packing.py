import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def held(rows, limits):
    """Sequences without gaps or overlaps, within all limits; the share of padding."""
    padding = tokens = 0
    for _, group in groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        group, at = list(group), 0
        for r in group:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(group) <= limits.segments and sum(r.n_loss for r in group) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
        tokens += at
    return padding / max(1, tokens)


def covered(rows, wanted):
    """``wanted``: {key: ids}; every id in one piece."""
    got = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r.start)):
        done = got.setdefault(r[0], [])
        assert r.start == len(done) and r.doc_tokens == len(wanted[r[0]])
        done.extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == {k: v for k, v in wanted.items() if v}


def test_ids_are_those_of_the_whole_text(tokenizer):
    dice = np.random.default_rng(5)
    signs = list("ab AB'19.,\t\n\r\x0b\x0c\x1c  　é\u0085ñß中文😀st́_-٣ⅷ") + ["'s", "don't ", "<|endoftext|>", "  ", "'ll"]
    texts = ["".join(dice.choice(signs, n)) for n in dice.integers(0, 60, 3000)]
    texts += ["", " ", "a" * 5000, "x y " * 3000, "'" * 200, "it's we'll 'été o'é"]
    chunks = pk.Chunks(PATH)
    for start in range(0, len(texts), 700):
        group = texts[start : start + 700]
        ids, bounds = chunks.encode(group)
        for i, found in enumerate(tokenizer.encode_batch(group, add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == found.ids, repr(group[i])


def test_windows_and_forgetting_change_nothing(tokenizer, monkeypatch):
    texts = [f"word{i} and {i * 7919} others, " * 20 for i in range(200)]
    want = [f.ids for f in tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(pk, "TOGETHER", 300)
    monkeypatch.setattr(pk, "MEMORY", 50)
    ids, bounds = pk.Chunks(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pk.pack_texts(docs, PATH, 1).collect()
    wanted = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    covered(rows, wanted)
    assert held(rows, pk.Limits()) < 0.001
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in pk.op12_packing(spark, folder).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


@pytest.mark.parametrize("limits", [pk.Limits(64, 5, 20), pk.Limits(16, 16, 1), pk.Limits(100, 1, 100), pk.Limits(1, 1, 1)])
def test_all_limits_hold(spark, limits):
    dice = np.random.default_rng(3)
    made = [(i, dice.integers(0, 1 << 31, n).tolist(), dice.integers(0, 2, n).tolist()) for i, n in enumerate(dice.integers(0, 150, 120))]
    df = spark.createDataFrame(made, "k long, ids array<int>, bears array<int>").withColumn("start", F.lit("x")).repartition(3)
    rows = pk.pack(df, "k", loss="bears", limits=limits).collect()
    covered(rows, {k: ids for k, ids, _ in made})
    held(rows, limits)
    flags = {k: bears for k, _, bears in made}
    assert all(r.n_loss == sum(flags[r.k][r.start : r.start + r.length]) for r in rows)


def test_the_open_sequence_takes_the_largest_product():
    def piece(key, n, loss):
        return pk.Piece(key, 0, np.zeros(n, np.uint32), np.minimum(np.arange(n + 1), loss), n)

    # "b" is longer, but loss is what is short
    packer = pk.Packer(pk.Limits(100, 10, 10))
    for one in (piece("a", 40, 10), piece("b", 60, 0), piece("c", 10, 8)):
        packer.add(one)
    assert [p.key for p in packer.sequence()] == ["a", "b"]
    assert [p.key for p in packer.sequence()] == ["c"] or len(packer)


def test_little_padding_for_short_and_for_long_examples(spark):
    short = spark.range(3000).select("id", F.expr("transform(sequence(1, 1 + id % 3), x -> int(x))").alias("ids")).coalesce(2)
    limits = pk.Limits(2048, 64, 2048)
    assert held(pk.pack(short, "id", limits=limits).collect(), limits) < 0.001
    long = spark.createDataFrame([(1, list(range(300_000))), (2, [5])], "id long, ids array<int>").coalesce(1)
    rows = pk.pack(long, "id").collect()
    assert len(rows) < 170 and held(rows, pk.Limits()) == 0


def test_odd_rows(spark, tokenizer):
    docs = documents(spark, [(1, None), (2, ""), (None, "null key"), (4, "same"), (4, "same"), (5, "z" * 20000), (6, "<|endoftext|>")])
    docs = docs.withColumn("length", F.lit("clash")).withColumn("ids", F.lit(0))
    rows = pk.pack_texts(docs.coalesce(1), PATH, 1).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * (len(tokenizer.encode("same").ids) + 1)
    covered([r for r in rows if r.doc_id != 4], {
        1: [1], 2: [1], None: tokenizer.encode("null key").ids + [1], 5: tokenizer.encode("z" * 20000).ids + [1],
        6: tokenizer.encode("<|endoftext|>").ids + [1],
    })
    assert pk.pack_texts(docs.limit(0), PATH, 1).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert pk.pack(empty, "id").count() == 0
    with pytest.raises(ValueError):
        pk.Packer(pk.Limits(0, 1, 1))
