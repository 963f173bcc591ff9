import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, asked, k=10):
    good = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and None not in v
                   and all(map(math.isfinite, v)) and any(v) and len(v) == 4})
    out = {}
    for i, v in good:
        if i in asked and i not in out:
            far = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in good if j != i]
            out[i] = sorted(far)[:k]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, best in want.items():
        assert [j for _, j in got[i]] == [j for _, j in best]
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15) for (a, _), (b, _) in zip(got[i], best))


def test_a_search_of_all_leaves_is_exact(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERIES_IN_BLOCK", 3)
    monkeypatch.setattr(nb, "ROWS_TOGETHER", 50)
    dice = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(dice.integers(-3, 4, (300, 4)).astype(float))]  # many ties
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.5]) for i in range(120)] + [(7, rows[7][1]), (7, rows[7][1])]
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None, 2.0, 3.0]), (2003, [float("nan"), 1.0, 1.0, 1.0]),
             (2004, [float("inf"), 1.0, 1.0, 1.0]), (2005, []), (2006, [1.0, 2.0]), (None, [1.0] * 4)]
    asked = {0, 7, 50, 100, 1000, 1100, 2000, 2001, 2004, 2006}
    df = table(spark, rows).withColumn("leaves", F.lit(1)).withColumn("score", F.lit(2.0)).repartition(5)
    got = nb.search(df, df.filter(F.col("vec_id").isin(*asked) | F.col("vec_id").isNull()), share=99.0, sample=200, leaf=8)
    same(listed(got), brute(rows, asked))


def test_fewer_rows_than_asked_for_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])]
    df = table(spark, rows)
    same(listed(nb.search(df, df.filter("vec_id = 0"))), brute(rows, {0}))
    assert nb.search(df, df.filter("vec_id > 9")).count() == 0
    assert nb.search(table(spark, []), table(spark, [])).count() == 0
    assert nb.search(table(spark, rows[:1]), table(spark, rows[:1])).count() == 0


def test_leading_and_reaching_agree():
    dice = np.random.default_rng(1)
    x = dice.standard_normal((500, 6))
    forest = nb.grow(x, 4, 16, 3)
    x = dice.standard_normal((500, 6))
    leaves = np.stack([nb.lead(t, x) for t in forest], 1)
    held = np.bincount(leaves.ravel(), minlength=sum(map(nb.count_leaves, forest)))
    for i in range(20):
        assert nb.reach(forest, x[i], held, 1)[0] in leaves[i]
        assert sorted(nb.reach(forest, x[i], held, 1e9)) == list(range(len(held)))


def recall(got, x, asked, k=10):
    hit = 0
    for i in asked:
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        best = np.lexsort((np.arange(len(x)), far))[:k]
        hit += len(set(best.tolist()) & {j for _, j in got[i]})
        assert all(math.isclose(far[j], d, rel_tol=1e-9) for d, j in got[i])
    return hit / len(asked) / k


def held_by_leaves(x, share, asked):
    """The share of all rows that are a query's candidates."""
    forest = nb.grow(x[: nb.SAMPLE], nb.TREES, nb.LEAF, 7)
    leaves = np.stack([nb.lead(t, x) for t in forest], 1)
    held = np.bincount(leaves.ravel(), minlength=sum(map(nb.count_leaves, forest)))
    enough = max(share * len(x), nb.LEAST)
    return np.mean([np.isin(leaves, nb.reach(forest, x[i], held, enough)).any(1).mean() for i in asked])


def test_recall_without_structure(spark):
    """64 independent directions, beyond what LEAST covers: the leaves hold a part of the rows, and most neighbours."""
    x = np.random.default_rng(11).standard_normal((20_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(map(np.ndarray.tolist, x))}), "vec_id long, embedding array<float>")
    asked = list(range(0, 20_000, 400))
    got = listed(nb.search(df, df.filter("vec_id % 400 = 0")))
    wide = x.astype(float)
    assert sorted(got) == asked and recall(got, wide, asked) >= 0.9
    assert held_by_leaves(wide, nb.SHARE, asked[:10]) < 0.7


def test_recall_with_structure(spark):
    """Rows near surfaces of few dimensions, as learned vectors are: a small part of them is looked at."""
    dice = np.random.default_rng(12)
    bases = dice.standard_normal((40, 5, 64))
    which = dice.integers(0, 40, 20_000)
    x = np.einsum("nd,ndk->nk", dice.standard_normal((20_000, 5)), bases[which]) + 3 * dice.standard_normal((40, 64))[which]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(map(np.ndarray.tolist, x))}), "vec_id long, embedding array<double>")
    asked = list(range(0, 20_000, 400))
    got = listed(nb.search(df, df.filter("vec_id % 400 = 0"), share=0.0))
    assert sorted(got) == asked and recall(got, x, asked) >= 0.9
    assert held_by_leaves(x, 0.0, asked[:10]) < 0.1


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toArrow()
    assert rows["vec_id"].to_pylist() == list(range(rows.num_rows))
    got = listed(nb.op7_nearest(spark, folder))
    asked = list(range(0, rows.num_rows, 100))
    assert sorted(got) == asked and recall(got, nb.matrix(rows["embedding"]).astype(float), asked) >= 0.9
