"""The search queries: what must not reach the driver, how work spreads, and the batched forms of the string scores."""

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from seqloom.functions import digests, flat
from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.operators import models as B
from seqloom.operators import search as G
from seqloom.plans import searching as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_incomplete_rows_are_found_without_a_broadcast(spark):
    assert "Broadcast" not in plan(P.drop_incomplete(spark, SMALL))


@pytest.mark.parametrize("query", [P.unfinished, P.last_generation, P.log_mutations])
def test_logs_are_joined_without_a_broadcast(spark, query):
    assert "Broadcast" not in plan(query(spark, SMALL))


def test_the_log_is_made_once(spark):
    assert plan(P.last_generation(spark, SMALL)).count("SortAggregate") <= 2


def test_candidates_spread_with_the_targets(spark, monkeypatch):
    monkeypatch.setattr(P, "TARGETS_AT_ONCE", 5)
    rows = P.targets(spark, SMALL)
    n = rows.count()
    assert rows.rdd.getNumPartitions() == max(8, -(-n // 5)) > 8
    assert P.candidates(spark, SMALL).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


PAIRS = [("AC", "AD"), ("AC", "ACD"), ("", ""), ("", "A"), (None, "A"), (None, ""), (None, None), ("A", None), ("KKKK", "RKRK")]


@pytest.mark.parametrize("extra", [[], [("äc", "aç"), ("日本", "日木語")]])
def test_batched_strings_give_what_the_expressions_give(spark, extra, monkeypatch):
    monkeypatch.setattr(flat, "LETTERS_AT_ONCE", 6)
    df = spark.createDataFrame(PAIRS + extra, "a string, b string").coalesce(1)
    values = L.hydropathy()
    got = df.select(
        S.hamming("a", "b").alias("h"), S.letter_sum("a", values, 0.5).alias("s"),
        S.hamming("a", "b", batched=True).alias("hb"), S.letter_sum("a", values, 0.5, batched=True).alias("sb"),
    ).collect()
    assert [r["h"] for r in got] == [r["hb"] for r in got]
    assert [r["s"] for r in got] == [r["sb"] for r in got]


def test_alignment_of_unequal_strings_is_null(spark):
    table = L.similarity_scores()
    got = [r["s"] for r in spark.createDataFrame(PAIRS, "a string, b string").select(G.alignment_score("a", "b").alias("s")).collect()]
    want = [None if a is None or b is None or len(a) != len(b) else float(sum(table[x, y] for x, y in zip(a, b))) for a, b in PAIRS]
    assert got == want


def test_a_target_without_letters_is_searched_without_an_error(spark, tmp_path):
    rows = [(1, "salmon green"), (2, ""), (3, None), (4, "123")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["target_id"] for r in P.evolve_variants(spark, str(tmp_path)).collect()} <= {1}
    kept = {r["target_id"] for r in P.drop_incomplete(spark, str(tmp_path)).collect()}
    assert kept == {1}


def test_scores_are_made_with_the_variants(spark):
    found = plan(P.fitness(spark, SMALL))
    assert "MapInArrow" in found and "differing" not in found and "total_of" not in found


@pytest.mark.parametrize("texts", [["ACD", "", None, "A", "zB", "WY" * 9], ["Aä", "日本C", None]])
def test_single_variants_of_a_batch(texts, monkeypatch):
    monkeypatch.setattr(flat, "LETTERS_AT_ONCE", 60)
    got = [
        x for row, place, letter, seq in flat.single_variants(pa.array(texts, pa.string()), L.LETTERS)
        for x in zip(row.tolist(), place.tolist(), letter.tolist(), seq.to_pylist())
    ]
    assert got == [
        (r, i, j, t[:i] + a + t[i + 1 :])
        for r, t in enumerate(texts) for i, old in enumerate(t or "") for j, a in enumerate(L.LETTERS) if a != old
    ]


def test_variants_keep_their_targets_columns(spark):
    rows = spark.createDataFrame([(None, "AC", "x"), (2, "", None), (3, None, "y")], "target_id int, target string, other string")
    got = G.variants_single(rows)
    assert got.columns == ["target_id", "target", "other", "pos", "letter", "seq"]
    assert {(r["target_id"], r["other"], r["pos"]) for r in got.collect()} == {(None, "x", 1), (None, "x", 2)}
    assert got.count() == 38


def test_numbers_of_a_batch_are_rounded_as_columns_are(spark):
    ties = [k / 1024 for k in range(-40, 40)] + [0.0009765625, 2.0000000005, 1.0000000015, -0.0, 1e-300, 3e15 + 0.5, 1e300]
    x = np.array(ties + [float("nan"), float("inf")] + np.random.default_rng(1).normal(size=500).tolist())
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert np.array_equal(flat.half_up(x, 9), np.array(want), equal_nan=True)


def test_distances_of_a_batch(spark):
    rows = [("AC", "AD", 200.0), ("AC", "AD", 0.0), ("AC", "AD", None), ("AC", "A", 200.0), (None, "A", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, s double").coalesce(1)
    want = [r[0] for r in df.select(G.similarity_distance("a", "b", "s")).collect()]
    a, b, s = (pa.array(list(x), k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.float64())))
    assert G.similarity_distances()(a, b, s).to_pylist() == want


def test_digests_of_many_texts():
    prefixes = [b"", b"1:", b"12:", b"12345678:", b"x" * 47, b"y" * 48, b"z" * 70, "ä:".encode()]
    suffixes = [f"{m}:1:42:2".encode() for m in (1, 22, 333)]
    want = [[int(hashlib.md5(p + s).hexdigest()[:8], 16) for s in suffixes] for p in prefixes]
    assert digests.first_digits(prefixes, suffixes).tolist() == want


def test_couples_are_drawn_in_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "COUPLES", 8)
    ids = [None, "7", "a long name " * 6]
    rows = [(t, "AC", 200.0, None, m, s, float(m)) for t in ids for m, s in enumerate(["AA", "CC", None, "DD"])]
    df = spark.createDataFrame(rows, "target_id string, target string, self_score double, initial_p double, member int, seq string, fitness double")
    couples = G.parents(df, 5, 3, 2, 42)
    assert "md5" not in plan(couples)
    got = {(r["target_id"], r["member"]): (r["first"], r["second"]) for r in couples.collect()}

    def draw(t, m, side):
        text = f"{'' if t is None else t + ':'}{m}:2:42:{side}"
        return ["AA", "CC", None][int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 3]

    assert got == {(t, m): (draw(t, m, 1), draw(t, m, 2)) for t in ids for m in range(1, 6)}


def test_the_search_learns_with_the_default_settings(spark, monkeypatch):
    used, train = [], B.train_stumps

    def few(rows, vector, label, settings):
        used.append(settings)
        return train(rows, vector, label, replace(settings, iterations=2))

    monkeypatch.setattr(B, "train_stumps", few)
    P.trained(spark, SMALL)
    assert used == [B.BoostSettings()]


@pytest.fixture
def few_trees(monkeypatch):
    train = B.train_stumps
    monkeypatch.setattr(B, "train_stumps", lambda rows, vector, label, settings: train(rows, vector, label, replace(settings, iterations=2)))


@pytest.mark.parametrize("query", [P.score_candidates, P.objective])
def test_candidates_are_scored_without_a_join(spark, few_trees, query):
    found = plan(query(spark, SMALL))
    assert "Join" not in found and found.count("Exchange") == 1


def test_a_target_that_comes_twice_meets_both(spark):
    rows = spark.createDataFrame([(1, "AC", 1.0), (1, "DE", 2.0), (2, "F", 3.0), (None, "G", 4.0)], "target_id int, target string, s double")
    want = rows.select("target_id", "target").join(rows.select("target_id", "s"), "target_id")
    assert sorted(map(tuple, G.with_each(rows, "s").collect())) == sorted(map(tuple, want.collect()))


def dice(text, first, sides):
    return int(hashlib.md5(text.encode()).hexdigest()[first - 1 : first + 7], 16) % sides


def test_random_variants_throw_the_dice_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(G, "THROWN", 40)
    rows = [("7", "ACDEFG"), (None, "WYWYWYWYW"), ("a long name " * 6, "KR"), ("8", "A"), ("9", ""), ("10", None), ("11", "BACD")]
    got = G.variants_random(spark.createDataFrame(rows, "target_id string, target string").coalesce(1), 12, 50, 3).collect()

    def variant(t, text, m):
        for j in range(1, len(text) // 2 + 1):
            salt = f"{'' if t is None else t + ':'}{m}:{j}:3"
            at = dice(salt, 1, len(text))
            old = max(0, L.LETTERS.find(text[at]))
            text = text[:at] + L.LETTERS[(old + dice(salt, 9, 19) + 1) % 20] + text[at + 1 :]
        return text

    want = {(t, m): text and variant(t, text, m) for t, text in rows for m in range(1, 13)}
    assert {(r["target_id"], r["member"]): r["seq"] for r in got} == want and len(got) == len(want)


def test_children_throw_the_dice_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(G, "THROWN", 30)
    same = [("1", "ACDEFGHIKL", "WYWYWYWYWY"), (None, "AAAAA", "CCCCC"), ("3", "", ""), ("4", "DEFGHIKLMN", "PQRSTVWYAC")]
    other = [("5", "ACD", "WYWYWYWYWY"), ("6", None, "AC"), ("7", "AC", None)]

    def child(t, a, b):
        out = ""
        for i in range(max(len(a or ""), len(b or "")) if a is not None and b is not None else 0):
            salt = f"{'' if t is None else t + ':'}2:{i}"
            luck = dice(salt, 1, 100)
            out += a[i : i + 1] if luck < 45 else b[i : i + 1] if luck < 90 else L.LETTERS[dice(salt, 9, 20)]
        return out

    for rows in (same, same + other):
        df = spark.createDataFrame(rows, "t string, a string, b string").coalesce(1)
        got = df.select(G.crossover(F.col("a"), F.col("b"), F.col("t"), F.lit(2))).collect()
        assert [r[0] for r in got] == [child(*r) for r in rows]


def test_a_search_in_rounds_leaves_no_population_behind(spark, monkeypatch):
    want = sorted(map(tuple, P.evolve_variants(spark, SMALL).collect()))
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())

    def there():
        return {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}

    before = there()
    monkeypatch.setattr(G, "HELD", 4000)
    found = P.evolve_variants(spark, SMALL)
    assert not {f for f in there() - before if f.startswith("rdd-")}
    assert sorted(map(tuple, found.collect())) == want
