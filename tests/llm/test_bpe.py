import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fixtures import documents
from seqloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_trees_agree_with_the_library(library, encoder):
    dice = random.Random(5)
    texts = ["a" * n for n in (1, 47, 48, 49, 97, 1000, 4001)] + [" " * n for n in (7, 63, 129, 1001)]
    texts += ["=" * 333, "ab" * 500, "é" * 301, "日本語" * 90, "​" * 77, "0123456789" * 60]
    for alphabet in ("ab", "the and ing", "aeéèß", "-=_", "\U0001f600́x"):
        texts += ["".join(dice.choice(alphabet) for _ in range(n)) for n in (10, 100, 400, 1500)]
        texts += ["".join(dice.choice(alphabet.replace(" ", "")) for _ in range(n)) for n in (60, 700)]
    for text in texts:
        assert list(encoder.encode(text)) == library.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_every_code_point_is_split_as_the_library_does(library, encoder):
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        text = "".join(f"a{c} {c}1" for c in points[start : start + 4096])
        assert encoder.decode(encoder.encode(text)) == text.encode()
    plain = "".join(f"a{c} {c}1" for c in points[:0x2000])
    assert list(encoder.encode(plain)) == library.encode_ordinary(plain)


def test_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (4, "word " * 300_000), (None, "n"), (5, "<|endoftext|>")]
    docs = documents(spark, rows)
    got = sorted(bpe.round_trip(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(rows)
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        ids = library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert bpe.round_trip(documents(spark, [])).count() == 0
    docs = documents(spark, [(1, "a b")]).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    assert bpe.round_trip(docs).first().n_tokens == 2


def test_a_table_agrees_with_the_library(spark, library):
    from conftest import SMALL

    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode_ordinary(row.text or "")
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_the_tree_joins_most_documents(spark, library):
    from conftest import SMALL

    encoder, joined, entered = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN), 0, []
    join = encoder.join
    encoder.join = lambda left, right: entered.append(1) or join(left, right)
    texts = [row.text for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if row.text]
    for text in texts:
        encoder.known.clear()
        entered.clear()
        assert list(encoder.encode(text)) == library.encode_ordinary(text)
        joined += bool(entered)
    assert joined > 0.5 * len(texts)
