"""The shared block kernel: names, odd strings, the store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from seqloom.functions import lookups as L
from seqloom.operators import blocks as B
from seqloom.operators import composition as C
from seqloom.operators import lags as G
from seqloom.operators import selected as X
from seqloom.operators import tables as T
from seqloom.plans import blocks as PB

STD = L.standardized_rows()
STRINGS = ["ACDEFGHIKLMNPQRSTVWY" * 3, "AAAAAAAA", "KRKRDE", "AC", "W", "", None, "MKVLAAGIVGKRRDEWYFHH", "ACXBZ", "G" * 3000 + "KLMDE"]


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "ID long, seq string").repartition(2)


def long(df, names):
    cells = B.long_cells(B.block_cells(df, ["ID"], names=names), ["ID"], B.dictionary(df.sparkSession, names))
    return {(r["ID"], r["feature"]): r["value"] for r in cells.collect()}


def test_every_name_of_the_survey():
    assert len(B.NAMES) == 31
    assert B.descriptor("TPC type 1").features[:2] == ["TPC_AAA", "TPC_AAC"]
    names = [f for b in B.descriptors().values() for f in b.features]
    assert len(names) == len(set(names))
    with pytest.raises(ValueError):
        B.descriptor("nonsense")


@pytest.mark.parametrize(
    "block, other",
    [
        ("AAC", lambda df: C.kmer_frequency(df, ["ID"], 1).select("ID", F.concat(F.lit("AAC_"), "token").alias("feature"), "value")),
        ("TPC", lambda df: C.kmer_frequency(df, ["ID"], 3).select("ID", F.concat(F.lit("TPC_"), "token").alias("feature"), "value")),
        ("DDE", lambda df: C.pair_deviation(df, ["ID"]).select("ID", F.concat(F.lit("DDE_"), "token").alias("feature"), "value")),
        ("ASDC", lambda df: C.ordered_pairs(df, ["ID"]).select("ID", F.concat(F.lit("ASDC_"), "token").alias("feature"), "value")),
        ("Moran", lambda df: G.moran(df, ["ID"], STD, 4).select("ID", F.concat(F.lit("Moran_"), "prop", F.lit(".lag"), "lag").alias("feature"), "value")),
        ("Geary", lambda df: G.geary(df, ["ID"], STD, 4).select("ID", F.concat(F.lit("Geary_"), "prop", F.lit(".lag"), "lag").alias("feature"), "value")),
        ("PAAC", lambda df: G.pseudo_composition(df, ["ID"], L.property_rows()).select("ID", F.concat(F.lit("PAAC_"), "feature").alias("feature"), "value")),
    ],
)
def test_a_block_is_that_of_its_own_operator(strings, block, other):
    known = strings.filter("seq is null or seq not like '%X%'")
    want = {(r["ID"], r["feature"]): r["value"] for r in other(known).collect() if r["value"] is None or r["value"] != 0}
    got = long(known, [block])
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-9)) for k, v in want.items())


def test_sparse_joined_and_dense_rows_agree(spark, strings, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 3)
    monkeypatch.setattr(B, "DENSE_ROWS", 2)
    places = {f: at for f, at in B.dictionary(spark, B.NAMES).select("feature", "at").collect()}
    cells = {}
    for (key, feature), v in long(strings, B.NAMES).items():
        cells.setdefault(key, {})[places[feature]] = v
    joined = {r["ID"]: dict(zip(r["places"], r["values"])) for r in B.joined_cells(strings, ["ID"]).collect()}
    assert joined == cells and set(cells) == {i for i, s in enumerate(STRINGS) if s}
    for r in B.dense_blocks(strings, ["ID"]).collect():
        assert len(r["features"]) == len(places)
        assert {i: v for i, v in enumerate(r["features"]) if v is None or v != 0} == cells[r["ID"]]


def test_empty_tables_and_other_parameters(spark, strings):
    assert B.block_cells(strings.limit(0), ["ID"]).count() == 0 and B.joined_cells(strings.limit(0), ["ID"]).count() == 0
    own = B.Parameters(properties={"one": {a: 1.0 + i for i, a in enumerate(L.LETTERS)}, "two": {a: float(i % 3) for i, a in enumerate(L.LETTERS)}}, product_lags=2)
    assert B.descriptor("NMBroto", own).features == ["NMBroto_one.lag1", "NMBroto_one.lag2", "NMBroto_two.lag1", "NMBroto_two.lag2"]
    rows = B.dense_blocks(strings, ["ID"], names=["NMBroto", "AAIndex"], p=own).collect()
    std = L.standardized(own.properties["one"])
    s = STRINGS[0]
    got = next(r["features"] for r in rows if r["ID"] == 0)
    assert math.isclose(got[0], np.mean([std[a] * std[b] for a, b in zip(s, s[1:])]))
    assert got[4] == own.properties["one"][s[0]] and got[6] == own.properties["one"][s[-5]]


def test_store(spark, strings, tmp_path):
    names = ["AAC", "TPC type 1", "GAAC"]
    cells = B.block_cells(strings, ["ID"], names=names)
    store = B.BlockStore.write(cells, str(tmp_path / "s"), "stored_once", ["ID"], 3)
    again = B.BlockStore.open(spark, str(tmp_path / "s"), "stored_again", ["ID"], 3)
    want = {r["ID"]: (r["places"], r["values"]) for r in B.joined_cells(strings, ["ID"], names=names).collect()}
    for one in (store, again):
        got = {r["ID"]: (r["places"], r["values"]) for r in one.joined(names).collect()}
        # a string without a triple has no joined row
        assert got == {k: v for k, v in want.items() if len(STRINGS[k]) > 2 and STRINGS[k] != "ACXBZ"}
        text = one.joined(names)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "PartitionFilters: [isnotnull(block" in text


def test_selected_features_by_counts_and_by_expressions(spark):
    strings = ["ACDEFGHIKLMNPQRSTVWYKRKR"[:i] for i in range(24)] + ["KKRRSS" * 9, "LLAALP"]
    df = spark.createDataFrame(list(enumerate(strings)), "ID long, seq string")
    want = {r["ID"]: r for r in X.featurize(df, ["ID"]).collect()}
    got = X.counted_features(df, ["ID"]).collect()
    assert len(got) == len(strings)
    for r in got:
        for name in X.SELECTED_NAMES:
            assert r[name] == (None if want[r["ID"]][name] is None else pytest.approx(want[r["ID"]][name], abs=1e-9)), (r["ID"], name)
    one, other = X.counted_vector(df), X.model_vector(df)
    assert one.columns == other.columns
    a, b = ({r["ID"]: r["features"] for r in rows.collect()} for rows in (one, other))
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_long_blocks_of_other_makers_still_join(spark):
    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 2.0), (2, "a", 1.0)], "ID int, feature string, value double")
    joined = T.join_blocks([rows.filter("ID = 1"), rows.filter("ID = 2")], ["ID"])
    assert {r["ID"]: r["features"] for r in T.dense_features(joined, ["a", "b", "c"]).collect()} == {1: [2.0, 0.5, 0.0], 2: [1.0, 0.0, 0.0]}
    dense = T.dense_vectors(rows, T.feature_index(rows), ["ID"])
    assert {r["ID"]: r["features"] for r in dense.collect()} == {1: [2.0, 0.5], 2: [1.0, 0.0]}


def test_full_rows_are_summed_in_batches(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (2, [None, 1.0, None]), (3, [1e16, 1.0, -1e16])]
    df = spark.createDataFrame(rows, "id int, values array<double>")
    got = df.select("id", PB.dense_sums([1, 2, 3])("values").alias("s"))
    assert "zip_with" not in PB.dense_vectors(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (r["s"]["total"], r["s"]["weighted"]) for r in got.collect()} == {
        1: (0.1 + 0.2 + 0.3, 0.1 + 2 * 0.2 + 3 * 0.3), 2: (1.0, 2.0), 3: (1e16 + 1.0 - 1e16, 1e16 + 2.0 - 3e16),
    }


def test_some_cells_of_a_block():
    rng = np.random.default_rng(4)
    texts = ["", "A", "AC", "ACD", "XBX"] + ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYX"), n)) for n in rng.integers(0, 40, 40)] + ["ACDGILMS" * 900]
    strings, p = C.Strings(texts), B.Parameters()
    for block in B.descriptors().values():
        row, place, value = block.cells(B.Tally(strings, p))
        whole = np.zeros((len(texts), len(block.features)))
        whole[row, place] = value
        for n in (1, 3, len(block.features)):
            some = np.sort(rng.choice(len(block.features), min(n, len(block.features)), replace=False))
            got = block.values(B.Tally(strings, p, few=True), some)
            assert np.allclose(got, whole[:, some], rtol=1e-12, atol=1e-12, equal_nan=True), block.name


def test_named_features_do_not_count_every_cell():
    where = {f: b for b in B.descriptors().values() for f in b.features}
    wide = {where[f].name for f in X.SELECTED_NAMES if len(where[f].features) > 100}
    assert wide and all(B.descriptors()[name].some for name in wide)
