"""Ordinals, folds, metrics, sources and joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import folds as K
from seqloom.operators import metrics as M
from seqloom.operators import quantiles as Q
from seqloom.operators import symbols as Y
from seqloom.operators import tables as T
from seqloom.operators.ordinal import average_ranks, row_ordinals, running_totals
from seqloom.sources import fasta, tables as IO


@pytest.fixture(scope="module")
def hot(spark):
    """A group that holds two thirds of the rows."""
    draw = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", draw.randint(0, 20), i % 2) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, grp string, v long, y int"), rows


def test_running_totals_of_a_hot_group(hot):
    df, rows = hot
    got = {r["id"]: r["t"] for r in running_totals(df, ["grp"], ["v", "id"], {"t": "v"}).collect()}
    for g in {r[1] for r in rows}:
        total = 0
        for i, _, v, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            assert got[i] == total
            total += v


def test_the_hot_group_spreads(hot):
    df, _ = hot
    parts = df.repartitionByRange(8, "grp", "v", "id").filter("grp = 'hot'").select(F.spark_partition_id()).distinct()
    assert parts.count() > 2


def test_ordinals_without_groups(hot):
    df, rows = hot
    assert [r["ordinal"] for r in row_ordinals(df, [], ["id"]).orderBy("id").collect()] == list(range(1, len(rows) + 1))


def test_average_ranks_and_quantiles(hot):
    df, rows = hot
    ranks = {r["v"]: r["avg_rank"] for r in average_ranks(df.filter("grp='hot'"), [], "v").collect()}
    ordered = sorted(r[2] for r in rows if r[1] == "hot")
    for v in set(ordered):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert ranks[v] == pytest.approx(sum(places) / len(places))
    q = Q.exact_quantiles(df.filter("grp='hot'"), [], "v", {"q": 0.37}).first()["q"]
    at = 0.37 * (len(ordered) - 1)
    lo = ordered[int(at)]
    assert q == pytest.approx(lo + (ordered[int(at) + 1] - lo) * (at - int(at)))


def test_folds_partition_and_keep_the_classes(hot):
    df, rows = hot
    got = K.stratified_folds(df, ["id"], "y", 10).groupBy("fold", "y").count().collect()
    assert sum(r["count"] for r in got) == len(rows) and len(got) == 20
    for y in (0, 1):
        sizes = [r["count"] for r in got if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1
    one = K.create_folds(df, ["id"], "y", -1)
    assert one.select("fold").distinct().count() == len(rows)
    assert K.create_folds(df, ["id"], "y", 5, 3).groupBy("repeat").count().count() == 3


def test_auroc_properties(spark):
    draw = random.Random(2)
    rows = [(i, i % 2, round(draw.random(), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    a = M.auroc(df, [], "y", "p").first()["AUROC"]
    wins = [(p > q) + 0.5 * (p == q) for _, y, p in rows if y for _, z, q in rows if not z]
    assert a == pytest.approx(sum(wins) / len(wins))
    flipped = M.auroc(df.withColumn("p", 1 - F.col("p")), [], "y", "p").first()["AUROC"]
    assert a + flipped == pytest.approx(1)
    assert M.auroc(df.withColumn("p", F.lit(0.5)), [], "y", "p").first()["AUROC"] == 0.5
    assert M.auroc(df.filter("y = 1"), [], "y", "p").first()["AUROC"] is None


def test_metrics_of_an_empty_margin(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, yhat int")
    r = M.confusion(df, [], "y", "yhat").select(M.mcc().alias("m"), M.f1().alias("f"), M.sensitivity().alias("s")).first()
    assert (r["m"], r["f"], r["s"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        M.score_by("nonsense")
    assert M.evaluate(df.withColumn("p", F.lit(0.2)), "y", "p", lambda d, y, p: d.agg(F.max(p).alias("value"))).first()[0] == 0.2


TRAIN = ">a1 first one\r\nACDE\r\nFGHI\r\n>a2\r\nKKRR\r\n>a3|x y\r\nLLLL\r\n"
TEST = ">a1\nMMMMMM\n>b2 Negative by name\nKKRR\n"


def test_fasta_and_labels_by_position(spark, tmp_path):
    for name, text in (("tr.fa", TRAIN), ("te.fa", TEST), ("tr.csv", "CPP\r\n1\r\n0\r\n1\r\n"), ("te.csv", "CPP\n0\n1\n")):
        (tmp_path / name).write_bytes(text.encode())
    p = lambda n: str(tmp_path / n)
    rows = T.create_combined(spark, p("tr.fa"), p("tr.csv"), p("te.fa"), p("te.csv")).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a1", "ACDEFGHI", 1, "train"), ("a1", "MMMMMM", 0, "test"), ("a2", "KKRR", 0, "train"),
        ("a3|x", "LLLL", 1, "train"), ("b2", "KKRR", 1, "test"),
    ]
    comb = spark.createDataFrame(rows)
    block = comb.select("ID", "Dataset", F.length("Sequence").alias("n"))
    assert T.join_descriptor(comb, block).count() == 5
    train, test = T.select_split(comb, "train"), T.select_split(comb, "test")
    assert [r["ID"] for r in T.shared_sequences(train, test).collect()] == ["a2"]
    assert T.unshared_sequences(train, test).count() == 2


def test_unreadable_labels_and_records_without_an_id_keep_their_places(spark, tmp_path):
    texts = {
        "a.fa": ">A\nKK\n>\nRR\n> C note\nLL\n", "a.csv": "CPP\n0\nNA\n1\n\n", "b.fa": ">D\nMM\n", "b.csv": '"CPP"\n1\n',
        "short.csv": "CPP\n0\n1\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    p = lambda n: str(tmp_path / n)
    rows = T.create_combined(spark, p("a.fa"), p("a.csv"), p("b.fa"), p("b.csv")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("A", "KK", 0, "train"), (None, "RR", None, "train"), ("C", "LL", 1, "train"), ("D", "MM", 1, "test")], key=str
    )
    with pytest.raises(ValueError, match="3 rows with 2"):
        T.create_combined(spark, p("a.fa"), p("short.csv"), p("b.fa"), p("b.csv"))


def test_fasta_over_several_splits(spark, tmp_path):
    records = [(f"s{i}", "ACDEFGHIKLMNPQRSTVWY"[: 6 + i % 14] * 3) for i in range(400)]
    (tmp_path / "big.fa").write_text("".join(f">{i} note\n{s[:9]}\n{s[9:]}\n" for i, s in records))
    (tmp_path / "big.csv").write_text("CPP\n" + "".join(f"{i % 2}\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        read = fasta.read_sequences(spark, str(tmp_path / "big.fa"))
        assert read.rdd.getNumPartitions() > 3
        labels = fasta.read_label_rows(spark, str(tmp_path / "big.csv"))
        place = ["file", "block", "row"]
        got = {r["ID"]: (r["Sequence"], r["CPP"]) for r in T.positional_join(read, labels, place, place).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: (s, n % 2) for n, (i, s) in enumerate(records)}


def test_lookup_with_carriage_returns(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes(b"#\tA\tR\tN\r\nP\t0.62\t-2.53\t-0.78\r\nQ\t-0.5\t3\t0.2\r\n")
    got = {(r["prop"], r["letter"]): r["value"] for r in IO.read_lookup(spark, str(tmp_path / "m.txt"), "ARN").collect()}
    assert got["P", "R"] == -2.53 and got["Q", "N"] == 0.2 and len(got) == 6


def test_a_matrix_of_the_callers_own(spark, tmp_path):
    from seqloom.functions import lookups as L
    from seqloom.operators import search as G

    lines = ["Name\t" + "\t".join(L.ROW_ORDER)]
    lines += [a + "\t" + "\t".join("5" if a == b else "-1" for b in L.ROW_ORDER) for a in L.ROW_ORDER]
    (tmp_path / "s.txt").write_text("\r\n".join(lines) + "\r\n")
    scores = IO.lookup_pairs(IO.read_lookup(spark, str(tmp_path / "s.txt"), L.ROW_ORDER))
    df = spark.createDataFrame([("ACDE", "ACDF")], "a string, b string").withColumn("own", G.alignment_score("a", "a", scores))
    assert df.select(G.similarity_distance("a", "b", "own", scores).alias("d")).first()["d"] == pytest.approx(1 - 14 / 20)


def test_blocks_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "AAC", "a", 0.5), (1, "DPC", "aa", 0.1)], "ID int, block string, feature string, value double")
    IO.write_block(df, str(tmp_path / "b"))
    read = IO.read_block(spark, str(tmp_path / "b"), "AAC type 1")
    assert [r["feature"] for r in read.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(block" in read._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_one_heavy_user(spark):
    draw = random.Random(3)
    rows = [(1 if i % 3 else 2 + i % 5, i, draw.choice("SPE")) for i in range(900)]
    df = spark.createDataFrame(rows, "u long, t long, s string")
    got = {(r["u"], r["token"]): r["value"] for r in Y.symbol_ordered_pairs(df, "u", ["t"], "s", "SPE").collect()}
    text = "".join(s for u, _, s in rows if u == 1)
    n = len(text)
    want = sum(text[:j].count("S") for j in range(n) if text[j] == "P") / (n * (n - 1) / 2)
    assert got[1, "SP"] == pytest.approx(want)


def test_skewed_lookup_equals_a_join(spark, monkeypatch):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, rows.join(table, "k").collect()))
    monkeypatch.setattr(Q, "max", lambda a, b: b, raising=False)
    assert sorted(map(tuple, Q.skewed_lookup(rows, table, ["k"]).select("k", "id", "v").collect())) == plain


def test_the_layout_of_a_histogram_is_not_joined_by_sorting_all_rows(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.integers(0, 50, 4000) / 7, "b": rng.normal(size=300)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "grp string, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = Q.histogram_entropy(df, ["grp"], "v")
        got = {r["grp"]: (r["bins"], r["entropy"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    assert set(got) == {"a", "b"}
    for g, v in values.items():
        n = np.histogram(v, bins=got[g][0])[0] / len(v)
        assert abs(got[g][1] + (n[n > 0] * np.log(n[n > 0])).sum()) < 0.02
    # more groups than are sent
    held, Q.GROUPS = Q.GROUPS, 1
    try:
        assert {r["grp"]: r["bins"] for r in Q.histogram_entropy(df, ["grp"], "v").collect()} == {g: b for g, (b, _) in got.items()}
    finally:
        Q.GROUPS = held
