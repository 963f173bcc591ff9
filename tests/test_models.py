"""Models, neighbours, attribution and search: properties that must hold whatever was fitted."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from seqloom.operators import attribution as A
from seqloom.operators import dependence as D
from seqloom.operators import folds as K
from seqloom.operators import hpo as H
from seqloom.operators import metrics as M
from seqloom.operators import models as B
from seqloom.operators import neighbours as N
from seqloom.operators import search as G
from seqloom.operators import selected as X
from seqloom.session import cut

SETTINGS = B.BoostSettings(iterations=5, depth=2, min_rows=5, bins=32, patience=3)


@pytest.fixture(scope="module")
def data(spark):
    """Twelve features, of which the first two decide the label."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    y = (x[:, 0] + 0.8 * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(400)]
    return cut(spark.createDataFrame(rows, "id long, x array<double>, y int"))


NAMES = [f"f{i}" for i in range(12)]


def forest_of(spark, model, path):
    return B.Forest.of(B.tree_nodes(spark, model, str(path)))


def test_forest_scores_as_the_model_does(spark, data, tmp_path):
    model = B.train_boosted(data, "x", "y", SETTINGS)
    ours = data.withColumn("p", forest_of(spark, model, tmp_path / "m").score("x"))
    theirs = model.transform(ours.withColumn("features", array_to_vector("x")))
    gap = theirs.select(F.max(F.abs(F.col("p") - vector_to_array("probability")[1]))).first()[0]
    assert gap < 1e-9


def test_saved_model_scores_the_same(spark, data, tmp_path):
    model = B.train_stumps(data, "x", "y", SETTINGS)
    B.save_model(model, str(tmp_path / "s"), 4)
    again, facts = B.load_model(spark, str(tmp_path / "s"))
    assert facts["best_iteration"] == 4
    a, b = forest_of(spark, model, tmp_path / "a"), forest_of(spark, again, tmp_path / "b")
    both = data.select(F.max(F.abs(a.score("x") - b.score("x")))).first()[0]
    assert both == 0


def test_additive_attributions_add_up(spark, data, tmp_path):
    model = B.train_stumps(data, "x", "y", SETTINGS)
    nodes = B.tree_nodes(spark, model, str(tmp_path / "m"))
    forest, stumps = B.Forest.of(nodes), cut(B.stump_table(nodes))
    total = A.stump_attribution(data, ["id"], "x", stumps).groupBy("id").agg(F.sum("attribution").alias("a"))
    p = data.select("id", forest.score("x").alias("p")).withColumn("m", 0.5 * F.log(F.col("p") / (1 - F.col("p"))))
    joined = total.join(p, "id").toPandas()
    assert np.allclose(joined["a"], joined["m"] - joined["m"].mean())


def test_cross_validation(spark, data, tmp_path):
    rows = cut(K.stratified_folds(data, ["id"], "y", 4))
    train, test = rows.filter("fold < 3"), rows.filter("fold = 3")
    r = B.cross_validate(train, test, ["id"], "x", "y", NAMES, SETTINGS, str(tmp_path), refit_multiplier=1.5)
    scores = {(s["dataset"], s["fold"]): s["AUROC"] for s in r.scores.collect()}
    assert set(scores) == {(d, f) for d in ("Train", "Valid") for f in range(3)} | {("Test_ensemble", 0), ("Test_refit", 0)}
    assert min(scores.values()) > 0.75
    assert r.train_predictions.filter("p is not null").count() == train.count()
    assert r.test_predictions.filter("models = 3").count() == test.count()
    split = {i["feature"]: i["split"] for i in r.importances.groupBy("feature").agg(F.sum("split").alias("split")).collect()}
    assert len(split) == 12 and max(split, key=split.get) in ("f0", "f1")


def test_contributions_add_up_and_are_averaged_per_fold(spark, data, tmp_path):
    rows = cut(K.stratified_folds(data, ["id"], "y", 3))
    train, test = rows.filter("fold < 2"), rows.filter("fold = 2")
    r = B.cross_validate(train, test, ["id"], "x", "y", NAMES, SETTINGS, str(tmp_path), refit=False)
    x = lambda df: np.stack([q["x"] for q in df.select("x").collect()])
    got = {(a["dataset"], a["fold"], a["feature"]): a["attribution"] for a in r.attributions.collect()}
    assert len(got) == 3 * 2 * 12
    for f, forest in enumerate(r.forests):
        parts = {"Valid": x(train.filter(F.col("fold") == f)), "Train": x(train.filter(F.col("fold") != f)), "Test": x(test)}
        roots = sum(t["prediction"][0] * t["weight"] for t in forest.trees[: r.best_iteration])
        for name, own in parts.items():
            each = forest.contributions(own, r.best_iteration)
            assert np.allclose(each.sum(axis=1) + roots, forest.margins(own)[:, r.best_iteration - 1])
            assert np.allclose([got[name, f, n] for n in NAMES], np.abs(each).mean(axis=0))
    table = B.fold_importances(r).collect()
    assert len(table) == 24 and all(t["Train"] > 0 for t in table if t["split"] > 0)


def test_repeated_cross_validation(spark, data, tmp_path):
    rows = K.repeated_folds(data, ["id"], "y", 2, 2)
    r = B.cross_validate(
        rows, None, ["id"], "x", "y", NAMES, replace(SETTINGS, iterations=2), str(tmp_path), repeat="repeat", refit=False,
        metric=lambda df, y, p: df.agg(F.count("*").alias("value")),
    )
    assert r.scores.filter("dataset = 'Valid'").count() == 4
    assert r.train_predictions.filter("p is not null").count() == data.count()
    sizes = {(c["dataset"], c["fold"]): c["value"] for c in r.custom.collect()}
    assert set(sizes) == {(d, f) for d in ("Train", "Valid") for f in range(4)}
    assert sum(sizes.values()) == 4 * data.count()
    assert all(sizes["Train", f] + sizes["Valid", f] == data.count() for f in range(4))


def test_a_custom_metric_agrees_with_the_report(spark, data, tmp_path):
    rows = K.stratified_folds(data, ["id"], "y", 2)
    r = B.cross_validate(
        rows, None, ["id"], "x", "y", NAMES, replace(SETTINGS, iterations=2), str(tmp_path), refit=False,
        metric=lambda df, y, p: df.agg(F.avg(((F.col(p) > 0.5).cast("int") == F.col(y)).cast("double")).alias("value")),
    )
    want = {(s["dataset"], s["fold"]): s["ACC"] for s in r.scores.collect()}
    assert {(c["dataset"], c["fold"]): c["value"] for c in r.custom.collect()} == pytest.approx(want)


def test_folds_of_single_rows_are_not_fitted(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "MOST_FITS", 10)
    rows = K.leave_one_out(data, ["id"])
    with pytest.raises(ValueError, match="more than 10 folds"):
        B.cross_validate(rows, None, ["id"], "x", "y", NAMES, SETTINGS, str(tmp_path))


def test_scaling_fills_gaps(spark):
    from seqloom.operators.scaling import fit_vector_scaler

    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [None, 5.0]), (2, [3.0, 5.0]), (3, [8.0, 5.0])], "id int, x array<double>")
    got = np.array([r["x"] for r in df.withColumn("x", fit_vector_scaler(df, "x")("x")).orderBy("id").collect()])
    want = np.array([1.0, 3.0, 3.0, 8.0])
    assert np.allclose(got[:, 0], (want - want.mean()) / want.std()) and np.allclose(got[:, 1], 0)


def test_stopping_rule(spark):
    means = [0.5, 0.6, 0.55, 0.58, 0.59, 0.7, 0.6, 0.6]
    curve = spark.createDataFrame([(f, i + 1, m + f * 0.1) for f in range(2) for i, m in enumerate(means)], "fold int, iteration int, metric double")
    assert B.best_iteration(curve, 3).first()["iteration"] == 2
    assert B.best_iteration(curve, 4).first()["iteration"] == 6


def test_forward_selection_finds_the_signal(spark, data, tmp_path):
    rows = K.stratified_folds(data, ["id"], "y", 2)
    steps = B.forward_selection(
        rows, None, ["id"], "x", "y", NAMES, replace(SETTINGS, iterations=2, depth=1), str(tmp_path), "AUROC",
        max_features=2, candidates=[0, 1, 5], refit=False,
    ).collect()
    assert steps[0]["feature"] in ("f0", "f1") and len(steps) <= 2


def test_a_shortlist_looks_at_all_features(spark, data, tmp_path):
    rows = K.stratified_folds(data, ["id"], "y", 2)
    steps = B.forward_selection(
        rows, None, ["id"], "x", "y", NAMES, replace(SETTINGS, iterations=2, depth=1), str(tmp_path), "AUROC",
        max_features=2, shortlist=2, refit=False,
    ).collect()
    assert {s["feature"] for s in steps} == {"f0", "f1"}


def test_stopping_on_other_metrics(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, int(y), float(p)) for f in range(2) for i in range(1, 4) for y, p in zip(rng.integers(0, 2, 50), rng.random(50))]
    df = spark.createDataFrame(rows, "fold int, iteration int, _y int, p double")
    mine = lambda df, by, y, p: df.groupBy(*by).agg((1 - F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("metric"))
    for stop_on in ("AUROC", "MCC", "accuracy", mine):
        got = {(r["fold"], r["iteration"]): r["metric"] for r in B.stopping_curve(df, stop_on).collect()}
        assert len(got) == 6
        if stop_on == "accuracy":
            own = [(y, p) for f, i, y, p in rows if (f, i) == (0, 2)]
            assert got[0, 2] == pytest.approx(np.mean([(p >= 0.5) == y for y, p in own]))
    with pytest.raises(ValueError):
        B.stopping_curve(df, "nonsense")


def test_a_search_goes_on_from_its_ledger(spark, data, tmp_path, monkeypatch):
    rows = cut(K.stratified_folds(data, ["id"], "y", 2))
    settings = H.grid({"C": [1e-6, 1.0]})
    plain = H.search(rows, "id", "x", "y", "fold", "logistic_l2", settings)
    ledger = str(tmp_path / "ledger")
    H.search(rows, "id", "x", "y", "fold", "logistic_l2", settings[:1], ledger=ledger)
    fitted = []
    fit = H._fit_predict
    monkeypatch.setattr(H, "_fit_predict", lambda family, setting, *a: fitted.append(setting) or fit(family, setting, *a))
    whole = H.search(rows, "id", "x", "y", "fold", "logistic_l2", settings, ledger=ledger)
    assert fitted == [settings[1]] * 2
    order = ["setting", "fold"]
    assert whole.orderBy(*order).select("params", "fold", "MCC").collect() == plain.orderBy(*order).select("params", "fold", "MCC").collect()
    assert H.search(rows, "id", "x", "y", "fold", "logistic_l2", settings, ledger=ledger).count() == 4 and len(fitted) == 2


def test_several_predictors_are_averaged(spark):
    df = spark.createDataFrame([(1, 0.2)], "id int, x double")
    one, two = (lambda df: df.withColumn("p", F.col("x"))), (lambda df: df.withColumn("p", F.lit(0.6)))
    assert G.average_of([one, two])(df).first().asDict() == {"id": 1, "x": 0.2, "p": 0.4}


def test_search_over_settings(spark, data):
    rows = K.stratified_folds(data, ["id"], "y", 2)
    best = H.best_setting(H.search(rows, "id", "x", "y", "fold", "logistic_l2", H.grid({"C": [1e-6, 1.0]}))).first()
    assert "1.0" in best["params"] and best["MCC_mean"] > 0.6
    assert H.random_draws(H.SPACES["boosted"], 5, 1) == H.random_draws(H.SPACES["boosted"], 5, 1)
    assert len(H.grid(H.SPACES["logistic_l1"])) == 100


def brute(x, k, p, skip):
    out = set()
    for i in range(len(x)):
        d = (np.abs(x - x[i]) ** p).sum(axis=1) ** (1 / p)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not (skip and j == i)][:k]
        out |= {(i, int(j), n + 1) for n, j in enumerate(order)}
    return out


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("skip", [True, False])
def test_neighbours_both_ways(spark, p, skip):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[:100] = x[0]  # a third of the rows are copies of one point
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    want = brute(x, 5, p, skip)
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 32}):
        got = N.knn_join(df, df, 5, "id", "x", p, skip, **options)
        assert {(r["query_id"], r["train_id"], r["place"]) for r in got.collect()} == want


def test_text_keys_repeated_keys_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "LANE", 40)
    monkeypatch.setattr(N, "QUERIES", 7)
    monkeypatch.setattr(N, "TILE", 11)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 3)), 1)
    x[:70] = x[0]
    rows = [(f"key {i:04d}", [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, ("none", None, 1)], "id string, x array<double>, y int").repartition(4)
    want = {(f"key {i:04d}", f"key {j:04d}", n) for i, j, n in brute(x, 6, 2, True)}
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 30}):
        got = N.knn_join(df, df, 6, "id", "x", skip_self=True, **options)
        assert {(r["query_id"], r["train_id"], r["place"]) for r in got.collect()} == want
    votes = N.knn_classify(df, df, 6, "id", "x", "y", skip_self=True)
    assert votes.count() == 200 and dict(votes.dtypes)["query_id"] == "string"
    fit = N.lof_fit(df, "id", "x", 6)
    assert fit.count() == 200 and N.lof_score(df, df, fit, "id", "x", 6).count() == 200
    few = df.filter("x is not null").orderBy("id").limit(3)
    assert N.knn_join(few, few, 6, "id", "x", skip_self=True, broadcast_bytes=0, block_rows=2).count() == 6
    twice = few.unionByName(few)
    assert N.knn_join(few, twice, 9, "id", "x", skip_self=True, broadcast_bytes=0, block_rows=2).count() == 12
    best = H.search(K.stratified_folds(df.filter("x is not null"), ["id"], "y", 2), "id", "x", "y", "fold", "knn", [{"k": 3, "weights": "uniform", "p": 1}])
    assert best.count() == 2


def test_neighbours_need_the_memory_of_a_tile():
    import tracemalloc

    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(256, 64)), rng.normal(size=(100_000, 64))
    t[::3] = t[0]  # a third of the rows tie
    tracemalloc.start()
    row, at, d = N.nearest(q, t, 20, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 128 << 20 and len(row) == 256 * 20
    exact = np.sqrt(((q[5] - t) ** 2).sum(axis=1))
    assert at[row == 5].tolist() == np.lexsort((np.arange(len(t)), exact))[:20].tolist()


def test_few_chunks_are_visited_where_rows_lie_in_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 50
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    seen = []
    plain = N.lined_up
    N.lined_up = lambda rows, asking, *a: seen.append(asking) or plain(rows, asking, *a)
    try:
        got = N.knn_join(df, df, 5, "id", "x", skip_self=True, broadcast_bytes=0, block_rows=64).collect()
    finally:
        N.lined_up = plain
    assert {(r["query_id"], r["train_id"], r["place"]) for r in got} == brute(x, 5, 2, True)
    copies = seen[1].count()
    assert copies < 2000 * 12  # of at least 32 chunks


def test_outlier_factor_by_loops(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(120, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    fit = N.lof_fit(df, "id", "x", 10)
    rows = {r["train_id"]: r["outlier"] for r in fit.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    kd = np.sort(d, axis=1)[:, 9]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1) + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    assert np.allclose([rows[i] for i in range(len(x))], want)
    assert max(rows, key=rows.get) == 120
    assert N.fit_label(fit, 0.1).filter("label = -1").count() == 12
    vec = df.withColumn("features", F.col("x"))
    small = G.outlier_column(df, "id", "x", 10)(vec).select("id", "outlier").toPandas().set_index("id")["outlier"]
    joined = {r["query_id"]: r["outlier"] for r in N.lof_score(df, df, fit, "id", "x", 10).collect()}
    assert np.allclose(small.sort_index(), [joined[i] for i in range(len(x))])
    keyed = vec.withColumn("target_id", F.col("id")).withColumn("member", F.lit(1)).withColumn("seq", F.lit("A"))
    large = G.outlier_column(df, "id", "x", 10, limit=0)(keyed).toPandas().set_index("id")["outlier"]
    assert np.allclose(small.sort_index(), large.sort_index())


def test_sampled_attribution_adds_up(spark, data, monkeypatch):
    predict = lambda x: 2 * x[:, 0] - x[:, 1] * x[:, 2]
    players = [[0], [1, 2], list(range(3, 12))]
    whole = A.sampled_attribution(data, ["id"], "x", predict, players, background_rows=30, permutations=4)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    got = whole.toPandas().pivot(index="id", columns="player", values=["attribution", "error"])
    x = np.stack(data.orderBy("id").toPandas()["x"].to_list())
    z = A.background(data, ["id"], "x", 30)
    assert np.allclose(got["attribution"].sum(axis=1), predict(x) - predict(z).mean())
    assert np.allclose(got["attribution"][0], 2 * x[:, 0] - 2 * z[:, 0].mean())
    assert np.allclose(got["error"][0], 2 * np.tile(z[:, 0], 2).std(ddof=1) / np.sqrt(60))
    assert np.abs(got["attribution"][2]).max() < 1e-12
    # an order and its reverse give the exact value of two players that multiply
    exact = A.sampled_attribution(data, ["id"], "x", predict, [[1], [2], [0, *range(3, 12)]], background_rows=30, permutations=2)
    one = exact.filter("player = 0").orderBy("id").toPandas()["attribution"]
    want = -np.mean((x[:, None, 1] - z[None, :, 1]) * (x[:, None, 2] + z[None, :, 2]) / 2, axis=1)
    assert np.allclose(one, want)
    monkeypatch.setattr(A, "LAID_OUT", 1)
    again = A.sampled_attribution(data, ["id"], "x", predict, players, background_rows=30, permutations=4)
    assert np.allclose(again.toPandas().pivot(index="id", columns="player", values="attribution"), got["attribution"])
    with pytest.raises(ValueError):
        A.sampled_attribution(data, ["id"], "x", predict, players, permutations=3)


def test_permutation_importance(spark, data):
    out = A.permutation_importance(data, "id", "x", "y", lambda x: x[:, 0], [0, 1])
    drops = {r["feature"]: r["drop"] for r in out.collect()}
    assert drops[0] > 0.2 and abs(drops[1]) < 1e-12


def test_auroc_of_histograms_is_exact(spark):
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.normal(size=300), rng.normal(size=300) + 2, np.repeat([0.5, -0.5, 0.0, -0.0], 20)])
    y = np.concatenate([np.zeros(300), np.ones(300), rng.integers(0, 2, 80)]).astype(int)
    rows = [(i % 2, int(b), float(s), int(v), 1 - int(v)) for i, (b, s, v) in enumerate(zip(A._ordered_bits(score), score, y))]
    assert (np.diff(A._ordered_bits(np.sort(score))) >= 0).all()
    df = spark.createDataFrame(rows, "g int, bin long, score double, pos long, neg long")
    got = {r["g"]: r["AUROC"] for r in M.auroc_of_histograms(df, ["g"]).collect()}
    want = {r["g"]: r["AUROC"] for r in M.auroc(df.withColumn("score", F.col("score") + 0.0), ["g"], "pos", "score").collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_feature_groups_follow_chains(spark):
    edges = [(0, 1, 0.99), (1, 2, -0.97), (3, 4, 0.96), (4, 5, 0.5)]
    rows = [(a, b, v) for a, b, v in edges] + [(b, a, v) for a, b, v in edges] + [(i, i, 1.0) for i in range(7)]
    got = {r["feature"]: r["group"] for r in D.feature_groups(spark.createDataFrame(rows, "feature_i int, feature_j int, value double")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    with pytest.raises(ValueError):
        D.redundancy(None, "id", "x", "nonsense")


def test_mutual_information_with_many_bins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5))
    x[:, 1] = x[:, 0] ** 2
    x[:, 4] = 1.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    bins = np.array([400, 400, 400, 7, 1])
    low, span = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    place = np.minimum(np.floor(np.divide(x - low, span, out=np.zeros_like(x), where=span > 0) * bins), bins - 1).astype(int)
    want = {}
    for i in range(5):
        for j in range(i, 5):
            _, n = np.unique(place[:, i] * 1000 + place[:, j], return_counts=True)
            want[i, j] = sorted(n.tolist())
    for held in (200, 4 << 20):
        monkeypatch.setattr(D, "HELD", held)
        got = {}
        for r in D._pair_counts(df, "x", low, span, bins).collect():
            got.setdefault((r["feature_i"], r["feature_j"]), []).append(r["n"])
        assert {k: sorted(v) for k, v in got.items()} == want
    value = {(r["feature_i"], r["feature_j"]): r["value"] for r in D.mutual_information(df, "id", "x").collect()}
    assert value[0, 1] > 0.5 > value[0, 2] and value[3, 4] == 0.0 and value[4, 4] == 1.0
    assert all(value[i, j] == value[j, i] for i, j in value)


@pytest.fixture(scope="module")
def scoring(spark):
    rng = np.random.default_rng(9)
    strings = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), size=12)) for _ in range(60)]
    train = X.with_vector(spark.createDataFrame(list(enumerate(strings)), "id long, seq string"))
    outlier = G.outlier_column(cut(train), "id", "features", 5)
    return lambda df: df.withColumn("p", 1 / (1 + F.exp(2 - 8 * F.get("features", F.lit(0))))), outlier


def test_search_improves_and_repeats(spark, scoring):
    targets = spark.createDataFrame([(1, "ACDEFGHILMNP"), (2, "SSTTVVWWYYAA")], "target_id long, target string")
    settings = G.SearchSettings(population=40, generations=4, parents=10)
    runs = [G.evolve(targets, X.with_vector, *scoring, settings) for _ in range(2)]
    logs = [[tuple(r) for r in run.log.orderBy("target_id", "generation").collect()] for run in runs]
    assert logs[0] == logs[1] and len(logs[0]) == 8
    for t in (1, 2):
        curve = [r["fitness"] for r in runs[0].log.filter(F.col("target_id") == t).orderBy("generation").collect()]
        assert curve == sorted(curve, reverse=True)
    assert runs[0].best.groupBy("target_id", "n_diff").count().filter("count > 1").isEmpty()


def test_random_variants(spark):
    targets = spark.createDataFrame([(1, "ACDEFGHIKL")], "target_id long, target string")
    rows = G.variants_random(targets, 200, 50).collect()
    diffs = [sum(a != b for a, b in zip(r["target"], r["seq"])) for r in rows]
    assert len(rows) == 200 and all(len(r["seq"]) == 10 for r in rows) and 1 <= min(diffs) and max(diffs) == 5


def test_single_variants(spark):
    targets = spark.createDataFrame([(1, "ACA")], "target_id long, target string")
    rows = [r["seq"] for r in G.variants_single(targets).collect()]
    assert len(rows) == len(set(rows)) == 57


def test_crossover_shares(spark):
    df = spark.range(400).select("id", F.lit("A" * 50).alias("a"), F.lit("C" * 50).alias("c"))
    text = "".join(r[0] for r in df.select(G.crossover(F.col("a"), F.col("c"), F.col("id"))).collect())
    assert len(text) == 20000
    assert abs(text.count("A") / 20000 - 0.455) < 0.02 and abs(text.count("C") / 20000 - 0.455) < 0.02


def test_votes_search_the_neighbours_once(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    asking = df.mapInArrow(count, df.schema)
    assert len(N.knn_classify(asking, df, 5, "id", "x", "y", skip_self=True).collect()) == 60
    assert looked.value == 60


def test_queries_are_copied_to_groups_of_chunks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 32))  # every chunk can hold a neighbour
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    seen, plain = [], N.lined_up
    monkeypatch.setattr(N, "HELD", 100)
    monkeypatch.setattr(N, "LEAST", 30)
    monkeypatch.setattr(N, "lined_up", lambda rows, asking, *a: seen.append(asking) or plain(rows, asking, *a))
    for p in (1, 2):
        got = N.knn_join(df, df, 5, "id", "x", p, True, broadcast_bytes=0, block_rows=8).collect()
        assert {(r["query_id"], r["train_id"], r["place"]) for r in got} == brute(x, 5, p, True)
    # groups of 12 chunks, and chunks around 50 pivots are half empty
    assert len(seen) == 4 and seen[1].count() < 400 * 12


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("kind", ["plain", "far off", "heavy tails", "flat", "one value", "tiny", "queries far out", "not finite"])
def test_short_numbers_lose_no_neighbour(p, kind, monkeypatch):
    if kind == "not finite" and p == 2:
        pytest.skip("squares of rows that are not finite tell nothing; measured as before")
    monkeypatch.setattr(N, "TILE", 64)
    rng = np.random.default_rng(14)
    q, t = rng.normal(size=(40, 16)), rng.normal(size=(500, 16))
    if kind == "far off":
        q, t = q * 1e-3 + 1e6, t * 1e-3 + 1e6
    elif kind == "heavy tails":
        q, t = q**9, t**9
    elif kind == "flat":
        q[:, 1:], t[:, 1:] = 0, 0
    elif kind == "one value":
        t[:] = 3.0
    elif kind == "tiny":
        q, t = q * 1e-20, t * 1e-20
        t[0] = 1.0
    elif kind == "queries far out":
        q *= 1e9
    elif kind == "not finite":
        t[3, 2] = np.inf
        t[7, 1] = np.nan
    codes = np.arange(500) // 3
    held = N.Held(t, p, codes)
    own = rng.integers(0, 160, 40)
    for part in (np.arange(500), np.arange(5, 500, 2)):
        row, at, d = N.nearest(q, held, 6, p, None, own, rows=part)
        with np.errstate(invalid="ignore"):
            gap = q[:, None] - t[None, part]
            far = np.abs(gap).sum(axis=2) if p == 1 else np.sqrt((gap * gap).sum(axis=2))
        for i in range(40):
            open_ = np.flatnonzero((codes[part] != own[i]) & ~np.isnan(far[i]))
            want = part[open_[np.lexsort((open_, far[i][open_]))[:6]]]
            assert at[row == i].tolist() == want.tolist()
        limit = np.sort(far, axis=1)[:, 3]
        row, at, d = N.nearest(q, t, 6, p, limit, rows=part)
        within = [part[np.flatnonzero(far[i] <= limit[i])] for i in range(40)]
        assert all(set(at[row == i]) <= set(within[i]) and (row == i).sum() == min(6, len(within[i])) for i in range(40))


def test_boxes_give_the_nearest_rows():
    rng = np.random.default_rng(6)
    near = np.round(rng.normal(size=(700, 6)) * [30, 1, 9, 0, 100, 2])
    rows = np.vstack([near, near[:50], np.repeat(near[:1], 60, axis=0)])
    for x, k in ((rows, 20), (rows, 1), (rows[:25], 20), (rows[:25], 40), (np.vstack([near[:100], np.full((1, 6), np.inf)]), 5)):
        for q in (np.round(rng.normal(size=(600, 6)) * 20), rows[:90], rows[:0]):
            got, want = N.Boxed(x).top_k(q, k), N.top_k(q, x, k, 2)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    boxed, looked = N.Boxed(near), []
    whole = N.Held.pairs
    N.Held.pairs = lambda *a: looked.append(1) or whole(*a)
    try:
        boxed.top_k(near[:300], 20)
    finally:
        N.Held.pairs = whole
    assert not looked and len(boxed.rows) > 16


def test_two_leaf_trees_are_steps():
    rng = np.random.default_rng(7)
    leaf = {"left": np.array([-1]), "right": np.array([-1]), "feature": np.array([-1]), "cut": np.zeros(1)}
    trees = [
        {"prediction": rng.normal(size=3), "left": np.array([2, -1, -1]), "right": np.array([1, -1, -1]), "weight": 0.1,
         "feature": np.array([rng.integers(4), -1, -1]), "cut": np.array([rng.integers(6) / 2, 0, 0])} for _ in range(200)
    ] + [leaf | {"prediction": rng.normal(size=1), "weight": 1.0}]
    x = rng.integers(0, 8, (300, 4)) / 2
    x[0, :2] = np.nan
    forest = B.Forest(trees)
    assert np.allclose(forest.total(x), forest.margins(x)[:, -1], rtol=0, atol=1e-12)
