import numpy as np
import pytest
from pyspark.sql import functions as F
from harness import compare, connect

from seqloom.llm import mining as mn

SCHEMA = "vec_id long, label int, vector array<long>"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    good = [r for r in rows if None not in r and None not in r[2]]
    out = []
    for key, label, x in {(k, y, tuple(v)) for k, y, v in good if is_anchor(k)}:
        def score(v):
            return max(-(2**62), min(2**62, sum(a * b for a, b in zip(x, v))))

        others = sorted((-score(v), k, y) for k, y, v in good if k != key and len(v) == len(x))
        for s, p in [(-s, k) for s, k, y in others if y == label][:positives]:
            fits = [(-n, k) for n, k, y in others if y != label and low * s <= -100 * n <= high * s]
            out += [(key, p, i + 1, k, s, n) for i, (n, k) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in mn.mine(df, F.col("vec_id") % 5 == 0, **options).collect())


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in dict(FIRST=4, TOGETHER=16, FEW=20, BLOCK=7).items():
        monkeypatch.setattr(mn, name, value)


def test_against_all_pairs(spark, small_tiles):
    dice = np.random.default_rng(4)
    rows = [(i, int(dice.integers(0, 3)), dice.integers(-2, 4, 6).tolist()) for i in range(200)]  # many ties
    rows += [(1000 + i, i % 2, [1, 2, 3, 0, 1, 1]) for i in range(90)]  # one very common vector
    rows += [(i, 1, dice.integers(0, 5, 3).tolist()) for i in range(2000, 2030)] + [(3000, 0, []), (3001, 1, []), (3002, 0, [])]
    rows += [(5, 1, [9, 9, 9, 9, 9, 9]), rows[7], rows[7], rows[10], (None, 1, [1] * 6), (4000, None, [1] * 6), (4005, 1, None), (4010, 0, [1, None])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 anchor", "2 chunk", "'x' kind", "3 row").repartition(3)
    assert mined(df) == brute(rows, lambda k: k % 5 == 0)
    assert mined(df, positives=2, negatives=1, low=0, high=100) == brute(rows, lambda k: k % 5 == 0, 2, 1, 0, 100)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 5 <> 0")) == []


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [3**e + i, (-1) ** i * 5, 7 * i]) for i in range(25) for e in (20,)]
    rows += [(100 + i, i % 2, [2**40 + i, 2**31 - i, i]) for i in range(20)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda k: k % 5 == 0)


def test_bounds_hold_and_prune():
    dice = np.random.default_rng(0)
    for n in (1, 3, 16, 37, 64):
        a, b = mn.Vectors(dice.integers(-300, 300, (40, n))), mn.Vectors(dice.integers(-300, 300, (60, n)))
        true = a.x @ b.x.T
        widths = []
        for ma, da, mb, db in zip(a.means, a.deviations, b.means, b.deviations):
            middle, spread = ma @ mb.T, da @ db.T + 1e-6
            assert (middle - spread <= true).all() and (true <= middle + spread).all()
            widths.append(spread.mean())
        assert widths == sorted(widths, reverse=True)
    # rows of few directions, as real embeddings have them: most pairs are never scored
    centres = np.repeat(dice.integers(-300, 300, (50, 8)), 8, axis=1)
    which = dice.integers(0, 50, 20_000)
    x = centres[which] + dice.integers(-20, 21, (20_000, 64))
    chunk = mn.Chunk(np.arange(20_000), which % 10, x)
    best = chunk.positives(np.arange(0, 1000, 50), which[:1000:50] % 10, mn.Vectors(x[:1000:50]), 5)
    assert len(best.row) == 100 and chunk.scored < 0.15 * 20 * 2000
    own = (which % 10)[:1000:50]
    for i, key in enumerate(range(0, 1000, 50)):
        s = np.where((which % 10 == own[i]) & (np.arange(20_000) != key), x @ x[key], -(10**15))
        want = np.lexsort((np.arange(20_000), -s))[:5]
        assert sorted(best.row[best.group == i].tolist()) == sorted(want.tolist())


def test_quantized(spark):
    rows = [(1, 0, [0.5, -0.001]), (2, 0, None), (3, 0, [float("nan"), 1.0]), (4, 0, [1.0, None]), (5, 0, [float("inf")]), (6, 0, []), (7, None, [-1.0])]
    df = spark.createDataFrame(rows, "k long, y int, v array<float>")
    assert [tuple(r) for r in mn.quantized(df, "k", "y", "v").orderBy("k").collect()] == [(1, 0, [128, -1]), (6, 0, []), (7, None, [-256])]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_sql(spark, folder):
    status, rows, _, _, message = compare(spark, connect(folder), folder, "op11", mn.op11_hard_negatives, mn.SQL)
    assert status == "ok" and rows > 50, message
