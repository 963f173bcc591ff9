"""Descriptors against plain loops over the cited formulas, on strings made for the edges."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.operators import composition as C
from seqloom.operators import lags as G
from seqloom.operators import search as E
from seqloom.operators import selected as X
from seqloom.operators.titration import charge_zero
from seqloom.plans import descriptors as D

STRINGS = ["RKKRRQARR", "A", "AS", "WFWFY", "LALPLAASDMDMTTR", "KRRKAKRKRR", "MKVLAAGIVGLLLAQWERTYIPASDFGHKLCVNM" * 3]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "doc_id long, seq string")


def pair_share(s, a, b, gap):
    places = len(s) - gap - 1
    return sum(s[i] in a and s[i + gap + 1] in b for i in range(places)) / places if places > 0 else 0.0


def ordered(s, a, b):
    pairs = list(combinations(s, 2))
    return sum(x == a and y == b for x, y in pairs) / len(pairs) if pairs else None


def class_place(s, members, share):
    hits = [i + 1 for i, c in enumerate(s) if c in members]
    return hits[max(1, math.floor(share * len(hits))) - 1] / len(s) * 100 if hits else 0.0


def theta(s, rows, combine):
    if len(s) < 2:
        return None
    return [sum(combine(r[s[i]], r[s[i + 1]]) for i in range(len(s) - 1)) / (len(s) - 1) for r in rows]


def expected(s):
    std = list(L.standardized_rows().values())
    square = theta(s, std, lambda a, b: (a - b) ** 2)
    prod = theta(s, std[:2], lambda a, b: a * b)
    g = L.grantham()
    coupling = sum(g[s[i], s[i + d]] ** 2 for d in (1, 2, 3) for i in range(len(s) - d))

    def dde(a, b):
        if len(s) < 2:
            return None
        tm = L.CODONS[a] / 61 * L.CODONS[b] / 61
        return (pair_share(s, a, b, 0) - tm) / math.sqrt(tm * (1 - tm) / (len(s) - 1))

    group = L.group_of(L.SEVEN_GROUPS)
    triples = {}
    for i in range(len(s) - 4):
        t = group[s[i]], group[s[i + 2]], group[s[i + 4]]
        triples[t] = triples.get(t, 0) + 1
    triad = triples.get(("g5", "g5", "g5"), 0) / max(triples.values()) if triples else None
    over = lambda n, base: None if base is None else n / base
    pb = None if square is None else 1 + 0.05 * sum(square) / 3
    ab = None if prod is None else 1 + 0.05 * sum(prod)
    five = L.FIVE_GROUPS
    return [
        sum(c in "KR" for c in s) / len(s),
        class_place(s, "QSTNGDE", 0.5),
        pair_share(s, "I", "R", 2),
        class_place(s, "NVEQIL", 1.0),
        dde("L", "A"),
        ordered(s, "A", "S"),
        over(s.count("V"), pb),
        None if ab is None else 0.05 * prod[0] / ab,
        dde("L", "P"),
        pair_share(s, "L", "L", 4),
        over(s.count("A"), ab),
        class_place(s, "NTPG", 0.5),
        pair_share(s, five["postivecharger"], five["uncharger"], 1),
        triad,
        L.ZSCALES[s[0]][4],
        s.count("T") / (1 + 0.05 * coupling),
        ordered(s, "D", "M"),
        pair_share(s, "T", "R", 4),
        over(s.count("G"), pb),
        pair_share(s, five["uncharger"], five["aromatic"], 9),
    ]


def test_selected_features_follow_the_formulas(rows):
    got = X.with_vector(rows).orderBy("doc_id").collect()
    for s, r in zip(STRINGS, got):
        assert list(r["features"]) == pytest.approx(expected(s), nan_ok=True, abs=1e-9), s


def test_charged_fraction_golden(rows):
    r = rows.filter("doc_id = 0").select(S.class_fraction("seq", "KR").alias("v")).first()
    assert r["v"] == pytest.approx(7 / 9)


def test_frequencies_sum_to_one(rows):
    for k in (1, 2, 3):
        sums = C.kmer_frequency(rows, ["doc_id"], k).groupBy("doc_id").agg(F.sum("value").alias("s")).collect()
        assert len(sums) == sum(len(s) >= k for s in STRINGS)
        assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_ordered_pairs_sum_to_one(rows):
    sums = C.ordered_pairs(rows, ["doc_id"]).groupBy("doc_id").agg(F.sum("value").alias("s")).collect()
    assert len(sums) == sum(len(s) > 1 for s in STRINGS) and all(r["s"] == pytest.approx(1.0) for r in sums)


def test_lag_descriptors_by_loops(rows):
    row = L.standardized_rows()["Hydrophobicity"]
    got = {(r["doc_id"], r["lag"]): r["value"] for r in G.geary(rows, ["doc_id"], {"h": row}, 2).collect()}
    moran = {(r["doc_id"], r["lag"]): r["value"] for r in G.moran(rows, ["doc_id"], {"h": row}, 2).collect()}
    for i, s in enumerate(STRINGS):
        v = [row[c] for c in s]
        n, mean = len(v), sum(v) / len(v)
        spread = sum((x - mean) ** 2 for x in v)
        for d in (1, 2):
            if n <= 2 or spread < 1e-9:
                assert got.get((i, d)) is None
                continue
            diff = sum((v[j] - v[j + d]) ** 2 for j in range(n - d))
            assert got[i, d] == pytest.approx((n - 1) / (2 * (n - d)) * diff / spread)
            prod = sum((v[j] - mean) * (v[j + d] - mean) for j in range(n - d)) / (n - d)
            assert moran[i, d] == pytest.approx(prod / (spread / n))


def test_titration_is_the_best_grid_point(rows):
    def charge(s, ph):
        up = sum((1 if k == "n_end" else s.count(k)) / (1 + 10 ** (ph - pk)) for k, pk in L.PK_POSITIVE.items())
        return up - sum((1 if k == "c_end" else s.count(k)) / (1 + 10 ** (pk - ph)) for k, pk in L.PK_NEGATIVE.items())

    for s, r in zip(STRINGS, charge_zero(rows, ["doc_id"]).orderBy("doc_id").collect()):
        assert r["ph"] == pytest.approx(min((abs(charge(s, i / 100)), i / 100) for i in range(1401))[1])


def test_lookups():
    g = L.grantham()
    assert len(g) == 400 and all(g[a, b] == g[b, a] for a, b in g)
    assert sum(L.CODONS.values()) == 61
    for classes in L.THREE_CLASSES.values():
        assert sorted("".join(classes)) == sorted(L.LETTERS)
    assert sum(L.standardized_rows()["SideChainMass"].values()) == pytest.approx(0)


def test_strings_against_each_other(spark):
    df = spark.createDataFrame([("ACDEF", "ACDEF"), ("ACDEF", "AWDEFKK"), ("KKRR", "RRKK")], "a string, b string")
    d = df.withColumn("own", E.alignment_score("a", "a")).select(
        S.hamming("a", "b").alias("h"), E.similarity_distance("a", "a", "own").alias("zero"), S.terminal_reduce("b").alias("t")
    ).collect()
    assert [r["h"] for r in d] == [0, 1, 4]
    assert all(r["zero"] == 0 for r in d)
    assert [r["t"] for r in d] == ["AACDEF"[0] + "ACDEF", "ADEFKK", "RRRKK"]


def test_short_strings(spark):
    """What strings of zero to five letters give, worked out by hand."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([None, "", "A", "AK", "KKK", "AKAK", "AKRAK"])], "doc_id long, seq string")

    def got(df):
        return sorted(tuple(r) for r in df.collect())

    def share(k):
        return [(i, t, round(v, 4)) for i, t, v in got(C.kmer_frequency(rows, ["doc_id"], k))]

    assert share(1) == [(2, "A", 1.0), (3, "A", 0.5), (3, "K", 0.5), (4, "K", 1.0), (5, "A", 0.5), (5, "K", 0.5),
                        (6, "A", 0.4), (6, "K", 0.4), (6, "R", 0.2)]
    assert share(2) == [(3, "AK", 1.0), (4, "KK", 1.0), (5, "AK", 0.6667), (5, "KA", 0.3333),
                        (6, "AK", 0.5), (6, "KR", 0.25), (6, "RA", 0.25)]
    assert share(3) == [(4, "KKK", 1.0), (5, "AKA", 0.5), (5, "KAK", 0.5),
                        (6, "AKR", 0.3333), (6, "KRA", 0.3333), (6, "RAK", 0.3333)]
    pairs = [(i, t, round(v, 4)) for i, t, v in got(C.ordered_pairs(rows, ["doc_id"]))]
    assert pairs[:5] == [(3, "AK", 1.0), (4, "KK", 1.0), (5, "AA", 0.1667), (5, "AK", 0.5), (5, "KA", 0.1667)]
    assert {r["doc_id"] for r in C.pair_deviation(rows, ["doc_id"]).collect()} == {3, 4, 5, 6}
    by_lag = got(G.lag_sums(rows, ["doc_id"], {"one": {a: 1.0 for a in L.LETTERS}}, 3).select("doc_id", "lag", "places", "s_ab"))
    assert by_lag == [(3, 1, 1, 1.0), (4, 1, 2, 2.0), (4, 2, 1, 1.0), (5, 1, 3, 3.0), (5, 2, 2, 2.0), (5, 3, 1, 1.0),
                      (6, 1, 4, 4.0), (6, 2, 3, 3.0), (6, 3, 2, 2.0)]
    vectors = X.model_vector(rows.filter("seq IS NOT NULL")).collect()
    assert all(v is not None and v == v for r in vectors for v in r["features"])


@pytest.fixture(scope="module")
def empty_texts(spark, tmp_path_factory):
    """A folder whose documents have texts without a letter of the alphabet, or none."""
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", "123 !", "KRA", "AKRAKLLW"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_physicochemical_of_empty_texts(spark, empty_texts):
    found = {r["doc_id"]: r for r in D.physicochemical(spark, empty_texts).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    assert all(found[i]["Length"] == 0 and found[i]["Hydrophobicity"] is None for i in (0, 1, 2))
    mean = sum(L.hydropathy()[a] for a in "KRA") / 3
    assert found[3]["Hydrophobicity"] == pytest.approx(mean, abs=1e-6)


def test_legacy_features_of_empty_texts(spark, empty_texts):
    texts = spark.read.parquet(f"{empty_texts}/documents.parquet")
    rows = texts.select("doc_id", F.coalesce(S.clean_letters("text"), F.lit("")).alias("seq"))
    found = {r["doc_id"]: r for r in X.featurize(rows, ["doc_id"], choose=X.legacy_features).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    assert all(found[i]["Geary.lag2"] is None for i in (0, 1, 2)) and found[4]["Geary.lag2"] is not None
