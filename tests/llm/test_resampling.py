import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents

from seqloom.llm import resampling as rs


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """Rows (doc_id, n_features, weight, score, rank), sorted."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for key, text in docs:
        own = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    can = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(can[: 5 * len(can) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = rs.op13_resampling(spark, folder)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert rows_of(got) == brute(docs, target)


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, " .,; "), (None, many), (4, many), (4, many), (4, many)]
    docs += [(10 + i, f"Some WORDS-again{i} été 中文。naïve " * (i % 9)) for i in range(90)]
    target = ["some words again5", None, "", many]
    aim = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n_words long")
    df = documents(spark, docs).selectExpr("*", "1 n_features", "'x' rank", "2 buckets", "3 _row").repartition(4)
    assert rows_of(rs.resample(df, aim)) == brute(docs, target)
    assert rows_of(rs.resample(df, aim.limit(0))) == brute(docs, [])
    assert rs.resample(df.limit(0), aim).count() == 0


def test_equal_rows_fill_ranks(spark):
    docs = [(7, "one two three four five " * 5)] * 400
    got = rs.resample(documents(spark, docs).repartition(3), documents(spark, docs)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))


def test_long_texts_in_pieces(monkeypatch):
    dice = np.random.default_rng(1)
    text = " ".join(dice.choice(["a", "bc", "déf", "g1", "x" * 50], 3000)) + " " + "y" * 5000 + " end"
    want = sorted(buckets(text))
    for size in (1, 7, 64, 4999, 1 << 20):
        monkeypatch.setattr(rs, "PIECE", size)
        n, got = rs.features(text)
        assert n == len(words(text)) and sorted(got.tolist()) == want
    for short in ("", "a", "a b", "a b c"):
        monkeypatch.setattr(rs, "PIECE", 1)
        assert sorted(rs.features(short)[1].tolist()) == sorted(buckets(short))
    monkeypatch.setattr(rs, "PIECE", 1 << 20)
    n, got = rs.features("ab " * 2_000_000)
    assert n == 2_000_000 and len(got) == 5_999_997
