"""Queries over feature arrays: dependence, neighbours, outliers, attribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import attribution as A
from seqloom.operators import dependence as D
from seqloom.operators import folds as K
from seqloom.operators import metrics as M
from seqloom.operators import neighbours as N
from seqloom.operators import quantiles as Q
from seqloom.operators import stumps as P
from seqloom.operators.scaling import scaled_features
from seqloom.plans.base import query, r6, values
from seqloom.sources.tables import read_table


def emb(spark, folder):
    """(vec_id, x, y, label)."""
    return read_table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"), "label"
    )


EMB = (
    "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label%2 AS y, label FROM embeddings), "
    "lf AS (SELECT vec_id, y, unnest(x) AS v, CAST(unnest(range(0,len(x))) AS INTEGER) AS f FROM emb)"
)
NN = (
    "nd AS (SELECT a.vec_id AS q, b.vec_id AS t, list_distance(a.x,b.x) AS d FROM emb a CROSS JOIN emb b), "
    "nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS place FROM nd)"
)


# ---- dependence -------------------------------------------------------------

@query(
    "pearson_matrix",
    f"WITH {EMB} SELECT a.f AS feature_i, b.f AS feature_j, round(corr(a.v,b.v),6) AS value FROM lf a JOIN lf b USING (vec_id) GROUP BY 1,2",
)
def pearson_matrix(spark, folder):
    return D.redundancy(emb(spark, folder), "vec_id", "x", "pearson").select("feature_i", "feature_j", r6("value"))


@query(
    "spearman_matrix",
    f"WITH {EMB}, rk AS (SELECT vec_id, f, rank() OVER (PARTITION BY f ORDER BY v)+(count(*) OVER (PARTITION BY f,v)-1)/2.0::DOUBLE AS v FROM lf) "
    "SELECT a.f AS feature_i, b.f AS feature_j, round(corr(a.v,b.v),6) AS value FROM rk a JOIN rk b USING (vec_id) GROUP BY 1,2",
)
def spearman_matrix(spark, folder):
    return D.redundancy(emb(spark, folder), "vec_id", "x", "spearman").select("feature_i", "feature_j", r6("value"))


def layout_sql(source: str, by: str, value: str) -> str:
    return (
        f"q AS (SELECT {by}, count(*) AS n, min({value}) AS lo, max({value}) AS hi, quantile_cont({value},0.25) AS q1, "
        f"quantile_cont({value},0.75) AS q3 FROM {source} GROUP BY {by}), "
        f"lay AS (SELECT {by}, n, lo, hi, CAST(CASE WHEN hi>lo THEN ceil((hi-lo)/CASE WHEN q3>q1 THEN "
        "least((hi-lo)/(log2(n)+1), 2*(q3-q1)/pow(n,1.0::DOUBLE/3)) ELSE (hi-lo)/(log2(n)+1) END) ELSE 1 END AS INTEGER) AS bins FROM q), "
        f"bn AS (SELECT s.*, lay.bins, lay.n, CASE WHEN hi>lo THEN least(CAST(floor((s.{value}-lo)/(hi-lo)*lay.bins) AS INTEGER), lay.bins-1) ELSE 0 END AS bin "
        f"FROM {source} s JOIN lay USING ({by}))"
    )


@query(
    "nmi_matrix",
    f"WITH {EMB}, {layout_sql('lf', 'f', 'v')}, mg AS (SELECT f, bin, count(*)/CAST(max(n) AS DOUBLE) AS p FROM bn GROUP BY f, bin), "
    "h AS (SELECT f, -sum(p*ln(p)) AS h FROM mg GROUP BY f), "
    "jt AS (SELECT a.f AS fi, b.f AS fj, a.bin AS bi, b.bin AS bj, count(*)/CAST(max(a.n) AS DOUBLE) AS p FROM bn a JOIN bn b ON a.vec_id=b.vec_id AND a.f<b.f GROUP BY 1,2,3,4), "
    "mi AS (SELECT fi, fj, sum(jt.p*ln(jt.p/(x.p*z.p))) AS m FROM jt JOIN mg x ON x.f=fi AND x.bin=bi JOIN mg z ON z.f=fj AND z.bin=bj GROUP BY 1,2), "
    "up AS (SELECT fi, fj, round(greatest(0,least(1,m/sqrt(a.h*b.h))),6) AS value FROM mi JOIN h a ON a.f=fi JOIN h b ON b.f=fj) "
    "SELECT fi AS feature_i, fj AS feature_j, value FROM up UNION ALL SELECT fj, fi, value FROM up UNION ALL SELECT f, f, 1.0::DOUBLE FROM h",
)
def nmi_matrix(spark, folder):
    return D.redundancy(emb(spark, folder), "vec_id", "x", "mutual_info").select("feature_i", "feature_j", r6("value"))


@query(
    "model_dependence",
    f"WITH {EMB}, fo AS (SELECT vec_id, (row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id)-1)%10 AS fold FROM emb), "
    "en AS (SELECT f, min(v) AS lo, max(v) AS hi FROM lf GROUP BY f), "
    "b AS (SELECT lf.vec_id, fold, lf.f, v, least(CAST(floor((v-lo)/(hi-lo)*10) AS INTEGER),9) AS bin FROM lf JOIN en USING (f) JOIN fo USING (vec_id)), "
    "pr AS (SELECT x.vec_id, x.fold, x.f AS fx, x.bin, y.f AS fy, y.v FROM b x JOIN b y ON y.vec_id=x.vec_id AND y.f<>x.f), "
    "cb AS (SELECT fold, fx, bin, fy, count(*) AS n, sum(v) AS s FROM pr GROUP BY 1,2,3,4), "
    "tb AS (SELECT fx, bin, fy, sum(n) AS n, sum(s) AS s FROM cb GROUP BY 1,2,3), "
    "fb AS (SELECT fold, fx, fy, sum(n) AS n, sum(s) AS s FROM cb GROUP BY 1,2,3), "
    "al AS (SELECT fx, fy, sum(n) AS n, sum(s) AS s FROM fb GROUP BY 1,2), "
    "gs AS (SELECT cb.fold, cb.fx, cb.bin, cb.fy, CASE WHEN tb.n-cb.n>0 THEN (tb.s-cb.s)/(tb.n-cb.n) ELSE (al.s-fb.s)/(al.n-fb.n) END AS g, fb.s/fb.n AS m "
    "FROM cb JOIN tb ON tb.fx=cb.fx AND tb.bin=cb.bin AND tb.fy=cb.fy JOIN fb ON fb.fold=cb.fold AND fb.fx=cb.fx AND fb.fy=cb.fy JOIN al ON al.fx=cb.fx AND al.fy=cb.fy), "
    "r AS (SELECT pr.fold, pr.fx, pr.fy, 1-sum((v-g)*(v-g))/sum((v-m)*(v-m)) AS r2 FROM pr JOIN gs ON gs.fold=pr.fold AND gs.fx=pr.fx AND gs.bin=pr.bin AND gs.fy=pr.fy GROUP BY 1,2,3), "
    "w AS (SELECT fx, fy, greatest(0,avg(r2)) AS v FROM r GROUP BY 1,2), "
    "up AS (SELECT least(fx,fy) AS i, greatest(fx,fy) AS j, round(avg(v),6) AS value FROM w GROUP BY 1,2) "
    "SELECT i AS feature_i, j AS feature_j, value FROM up UNION ALL SELECT j, i, value FROM up UNION ALL SELECT f, f, 1.0::DOUBLE FROM en",
)
def model_dependence(spark, folder):
    return D.redundancy(emb(spark, folder), "vec_id", "x", "model_based").select("feature_i", "feature_j", r6("value"))


CORR = f"{EMB}, co AS (SELECT a.f AS i, b.f AS j, corr(a.v,b.v) AS v FROM lf a JOIN lf b USING (vec_id) GROUP BY 1,2)"


@query("dependence_distance", f"WITH {CORR} SELECT i AS feature_i, j AS feature_j, round(1-abs(v),6) AS value FROM co")
def dependence_distance(spark, folder):
    out = D.dependence_distance(D.pearson(emb(spark, folder), "vec_id", "x"))
    return out.select("feature_i", "feature_j", r6("value"))


GROUP_CUT = 0.16


@query(
    "feature_groups",
    f"WITH RECURSIVE {CORR}, ed AS (SELECT i, j FROM co WHERE abs(v) >= {GROUP_CUT} AND i<>j), "
    "reach AS (SELECT DISTINCT i, i AS j FROM co UNION SELECT r.i, e.j FROM reach r JOIN ed e ON e.i=r.j) "
    "SELECT i AS feature, min(j) AS \"group\" FROM reach GROUP BY i",
)
def feature_groups(spark, folder):
    return D.feature_groups(D.pearson(emb(spark, folder), "vec_id", "x"), GROUP_CUT).select("feature", "group")


@query(
    "feature_pairs",
    f"WITH {EMB}, fs AS (SELECT DISTINCT f FROM lf) SELECT a.f AS feature_i, b.f AS feature_j FROM fs a JOIN fs b ON a.f<b.f",
)
def feature_pairs(spark, folder):
    n = emb(spark, folder).agg(F.max(F.size("x"))).first()[0]
    return D.pairs_of(n, spark)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELTED = "me AS (" + " UNION ALL ".join(f"SELECT '{c}' AS prop, {c} AS v FROM lineitem" for c in NUMBERS) + ")"


@query(
    "histogram_entropy",
    f"WITH {MELTED}, {layout_sql('me', 'prop', 'v')}, c AS (SELECT prop, max(bins) AS bins, bin, count(*)/CAST(max(n) AS DOUBLE) AS p FROM bn GROUP BY prop, bin) "
    "SELECT prop, CAST(max(bins) AS INTEGER) AS bins, round(-sum(p*ln(p)),6) AS entropy FROM c GROUP BY prop",
)
def histogram_entropy(spark, folder):
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("prop"), F.col(c).alias("v")) for c in NUMBERS]))
    rows = read_table(spark, folder, "lineitem").select(cells)
    return Q.histogram_entropy(rows, ["prop"], "v").select("prop", "bins", r6("entropy"))


@query(
    "impute_scale",
    "WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, nullif(l_discount,0) AS b, nullif(l_tax,0) AS c FROM lineitem), "
    "m AS (SELECT median(a) AS a, median(b) AS b, median(c) AS c FROM f), "
    "g AS (SELECT l_orderkey, l_linenumber, coalesce(f.a,m.a) AS a, coalesce(f.b,m.b) AS b, coalesce(f.c,m.c) AS c FROM f CROSS JOIN m), "
    "s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM g) "
    "SELECT l_orderkey, l_linenumber, round((a-ma)/sa,6) AS a, round((b-mb)/sb,6) AS b, round((c-mc)/sc,6) AS c FROM g CROSS JOIN s",
)
def impute_scale(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"),
        F.nullif("l_discount", F.lit(0.0)).alias("b"), F.nullif("l_tax", F.lit(0.0)).alias("c"),
    )
    out = scaled_features(rows, ["a", "b", "c"])
    return out.select("l_orderkey", "l_linenumber", r6("a"), r6("b"), r6("c"))


# ---- neighbours and outliers ------------------------------------------------

@query("knn_join", f"WITH {EMB}, {NN} SELECT q AS query_id, t AS train_id, round(d,6) AS distance, CAST(place AS INTEGER) AS place FROM nn WHERE place <= 10")
def knn_join(spark, folder):
    rows = emb(spark, folder)
    return N.knn_join(rows, rows, 10, "vec_id", "x").select("query_id", "train_id", r6("distance"), "place")


@query(
    "knn_join_blocks",
    f"WITH {EMB}, {NN.replace('CROSS JOIN emb b', 'JOIN emb b ON a.vec_id <> b.vec_id')} "
    "SELECT q AS query_id, t AS train_id, round(d,6) AS distance, CAST(place AS INTEGER) AS place FROM nn WHERE place <= 10",
)
def knn_join_blocks(spark, folder):
    """The route a training table beyond the broadcast bound takes."""
    rows = emb(spark, folder)
    out = N.knn_join(rows, rows, 10, "vec_id", "x", skip_self=True, broadcast_bytes=0, block_rows=128)
    return out.select("query_id", "train_id", r6("distance"), "place")


def vote_sql(weight: str) -> str:
    return (
        f"WITH {EMB}, {NN.replace('CROSS JOIN emb b', 'JOIN emb b ON a.vec_id <> b.vec_id')}, "
        f"vt AS (SELECT q, y, {weight} AS w FROM nn JOIN emb ON emb.vec_id=t WHERE place <= 7) "
        "SELECT q AS query_id, round(sum(w*y)/sum(w),6) AS p1 FROM vt GROUP BY q"
    )


@query("knn_classify", vote_sql("1.0::DOUBLE"))
def knn_classify(spark, folder):
    rows = emb(spark, folder)
    return N.knn_classify(rows, rows, 7, "vec_id", "x", "y", skip_self=True).select("query_id", r6("p1"))


@query(
    "knn_classify_distance",
    vote_sql("CASE WHEN min(d) OVER (PARTITION BY q) = 0 THEN CASE WHEN d=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1/d END"),
)
def knn_classify_distance(spark, folder):
    rows = emb(spark, folder)
    return N.knn_classify(rows, rows, 7, "vec_id", "x", "y", weights="distance", skip_self=True).select("query_id", r6("p1"))


LOF = (
    f"{EMB}, {NN}, tr AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS place FROM nd WHERE q<>t), "
    "tk AS (SELECT * FROM tr WHERE place<=20), kd AS (SELECT q AS id, max(d) AS kd FROM tk GROUP BY q), "
    "ld AS (SELECT q AS id, 1/(avg(greatest(d,kd))+1e-10) AS lrd FROM tk JOIN kd ON kd.id=t GROUP BY q), "
    "fit AS (SELECT q AS id, max(kd.kd) AS kd, max(o.lrd) AS lrd, avg(n.lrd)/max(o.lrd) AS outlier FROM tk JOIN ld n ON n.id=t JOIN ld o ON o.id=q JOIN kd ON kd.id=q GROUP BY q)"
)


@query("lof_fit", f"WITH {LOF} SELECT id AS train_id, round(kd,6) AS k_distance, round(lrd,6) AS density, round(outlier,6) AS outlier FROM fit")
def lof_fit(spark, folder):
    out = N.lof_fit(emb(spark, folder), "vec_id", "x", 20)
    return out.select("train_id", r6("k_distance"), r6("density"), r6("outlier"))


@query(
    "lof_score",
    f"WITH {LOF}, ql AS (SELECT q, 1/(avg(greatest(d,kd))+1e-10) AS lrd FROM nn JOIN kd ON kd.id=t WHERE place<=20 GROUP BY q) "
    "SELECT nn.q AS query_id, round(avg(fit.lrd)/max(ql.lrd),6) AS outlier FROM nn JOIN fit ON fit.id=t JOIN ql ON ql.q=nn.q WHERE place<=20 GROUP BY nn.q",
)
def lof_score(spark, folder):
    rows = emb(spark, folder)
    fitted = N.lof_fit(rows, "vec_id", "x", 20)
    return N.lof_score(rows, rows, fitted, "vec_id", "x", 20).select("query_id", r6("outlier"))


@query(
    "fit_label",
    f"WITH {LOF}, c AS (SELECT quantile_cont(-outlier,0.1) AS o FROM fit) SELECT id AS train_id, CASE WHEN -outlier < o THEN -1 ELSE 1 END AS label FROM fit CROSS JOIN c",
)
def fit_label(spark, folder):
    return N.fit_label(N.lof_fit(emb(spark, folder), "vec_id", "x", 20), 0.1)


# ---- stumps and attribution -------------------------------------------------

# a small additive model: (feature, cut, low, high)
STUMPS = [
    (0, 0.05, -0.4, 0.6), (0, -0.1, -0.2, 0.1), (3, 0.0, 0.3, -0.5), (7, 0.12, -0.1, 0.9),
    (7, 0.02, 0.25, -0.15), (20, -0.05, 0.7, -0.2), (41, 0.0, -0.35, 0.35), (63, 0.08, 0.05, -0.6),
]
STUMP_SQL = values(STUMPS, "f, cut, low, high", "st")
TERMS = (
    f"{EMB}, {STUMP_SQL}, tm AS (SELECT vec_id, lf.f, max(v) AS v, sum(CASE WHEN v<=cut THEN low ELSE high END) AS term FROM lf JOIN st ON st.f=lf.f GROUP BY vec_id, lf.f), "
    "at AS (SELECT vec_id, f, v, term-avg(term) OVER (PARTITION BY f) AS a FROM tm)"
).replace(" at AS", " ab AS")


def stump_rows(spark, folder):
    stumps = spark.createDataFrame(STUMPS, "feature int, cut double, low double, high double")
    return A.stump_attribution(emb(spark, folder), ["vec_id"], "x", stumps)


@query("stump_attribution", f"WITH {TERMS} SELECT vec_id, f AS feature, round(v,6) AS value, round(a,6) AS attribution FROM ab")
def stump_attribution(spark, folder):
    return stump_rows(spark, folder).select("vec_id", "feature", r6("value"), r6("attribution"))


EMB_FOLD = "fo AS (SELECT vec_id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id)-1)%10 AS INTEGER) AS fold FROM emb)"


@query(
    "mean_abs_attribution",
    f"WITH {TERMS}, {EMB_FOLD}, pf AS (SELECT fold, f, avg(abs(a)) AS i FROM ab JOIN fo USING (vec_id) GROUP BY 1,2) "
    "SELECT f AS feature, round(avg(i),6) AS mean, round(stddev_samp(i),6) AS std FROM pf GROUP BY f",
)
def mean_abs_attribution(spark, folder):
    folds = K.stratified_folds(emb(spark, folder).select("vec_id", "y"), ["vec_id"], "y").select("vec_id", "fold")
    rows = stump_rows(spark, folder).join(folds, "vec_id")
    return M.mean_abs_attribution(rows).select("feature", r6("mean"), r6("std"))


@query("global_importance", f"WITH {TERMS} SELECT f AS feature, round(avg(abs(a)),6) AS mean_abs FROM ab GROUP BY f ORDER BY avg(abs(a)) DESC, f LIMIT 4")
def global_importance(spark, folder):
    return A.global_importance(stump_rows(spark, folder), 4).select("feature", r6("mean_abs"))


@query(
    "attribution_distribution",
    f"WITH {TERMS} SELECT f AS feature, count(*) AS n_rows, round(min(a),6) AS low, round(max(a),6) AS high, round(quantile_cont(a,0.25),6) AS q25, "
    "round(quantile_cont(a,0.5),6) AS q50, round(quantile_cont(a,0.75),6) AS q75 FROM ab GROUP BY f",
)
def attribution_distribution(spark, folder):
    out = A.attribution_distribution(stump_rows(spark, folder))
    return out.select("feature", "n_rows", *[r6(c) for c in ("low", "high", "q25", "q50", "q75")])


SPLITS = (
    f"{EMB}, en AS (SELECT f, min(v) AS lo, max(v) AS hi FROM lf GROUP BY f), p AS (SELECT avg(CAST(y AS DOUBLE)) AS p0 FROM emb), "
    "c AS (SELECT lf.f, least(CAST(floor((v-lo)/(hi-lo)*32) AS INTEGER),31) AS bin, count(*) AS n, sum(p0-y) AS g, sum(p0*(1-p0)) AS h FROM lf JOIN en USING (f) CROSS JOIN p GROUP BY 1,2), "
    "a AS (SELECT x.f, x.bin, sum(z.n) FILTER (WHERE z.bin<=x.bin) AS ln, sum(z.g) FILTER (WHERE z.bin<=x.bin) AS lg, sum(z.h) FILTER (WHERE z.bin<=x.bin) AS lh, "
    "sum(z.n) AS tn, sum(z.g) AS tg, sum(z.h) AS th FROM c x JOIN c z ON z.f=x.f GROUP BY 1,2), "
    "gn AS (SELECT f, bin, lg*lg/lh+(tg-lg)*(tg-lg)/(th-lh)-tg*tg/th AS gain FROM a WHERE ln>=20 AND tn-ln>=20)"
)


@query("stump_split", f"WITH {SPLITS} SELECT f AS feature, bin, round(gain,6) AS gain FROM gn")
def stump_split(spark, folder):
    return P.split_gains(emb(spark, folder), "x", "y", bins=32).select("feature", "bin", r6("gain"))


@query("stump_split_best", f"WITH {SPLITS} SELECT f AS feature, bin, round(gain,6) AS gain FROM gn ORDER BY round(gain,9) DESC, f, bin LIMIT 1")
def stump_split_best(spark, folder):
    return P.best_split(P.split_gains(emb(spark, folder), "x", "y", bins=32)).select("feature", "bin", r6("gain"))


# ---- sampled attribution and permutations, of the small additive model ------

BACKGROUND, ORDERS, SEED = 50, 8, 42
BACK = f"bk AS (SELECT vec_id FROM emb ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id LIMIT {BACKGROUND})"


def scorer(spark):
    """Scores to nine places, so that equal sums are equal in whatever order they were added up."""
    score = A.stump_scorer(spark.createDataFrame(STUMPS, "feature int, cut double, low double, high double"))
    return lambda x: np.round(score(x), 9)


def sampled_sql(owner: str) -> str:
    """``owner``: a table expression (f, player).  Every change is the same in all orders of an additive model."""
    return (
        f", {BACK}, ow AS ({owner}), gt AS (SELECT vec_id, player, sum(coalesce(term,0)) AS t FROM emb CROSS JOIN ow "
        "LEFT JOIN tm USING (vec_id, f) GROUP BY vec_id, player), "
        f"sm AS (SELECT x.vec_id, x.player, x.t-z.t AS gain FROM gt x JOIN (SELECT gt.* FROM gt JOIN bk USING (vec_id)) z USING (player) CROSS JOIN range({ORDERS // 2})) "
        "SELECT vec_id, CAST(player AS INTEGER) AS player, round(avg(gain),6)+0.0 AS attribution, round(stddev_samp(gain)/sqrt(count(*)),6) AS error FROM sm GROUP BY vec_id, player"
    )


def sampled(spark, folder, players):
    out = A.sampled_attribution(emb(spark, folder), ["vec_id"], "x", scorer(spark), players, BACKGROUND, ORDERS, SEED)
    return out.select("vec_id", "player", r6("attribution"), r6("error"))


@query("sampled_attribution", f"WITH {TERMS} " + sampled_sql("SELECT f, f AS player FROM (SELECT unnest(range(0,64)) AS f)"))
def sampled_attribution(spark, folder):
    return sampled(spark, folder, [[i] for i in range(64)])


@query(
    "grouped_attribution",
    f"WITH RECURSIVE {TERMS}, co AS (SELECT a.f AS i, b.f AS j, corr(a.v,b.v) AS v FROM lf a JOIN lf b USING (vec_id) GROUP BY 1,2), "
    f"ed AS (SELECT i, j FROM co WHERE abs(v) >= {GROUP_CUT} AND i<>j), "
    "reach AS (SELECT DISTINCT i, i AS j FROM co UNION SELECT r.i, e.j FROM reach r JOIN ed e ON e.i=r.j) "
    + sampled_sql("SELECT f, dense_rank() OVER (ORDER BY g)-1 AS player FROM (SELECT i AS f, min(j) AS g FROM reach GROUP BY i)"),
)
def grouped_attribution(spark, folder):
    """Players are the groups of features that depend on each other."""
    groups = D.feature_groups(D.pearson(emb(spark, folder), "vec_id", "x"), GROUP_CUT).groupBy("group").agg(
        F.sort_array(F.collect_list("feature")).alias("members")
    )
    return sampled(spark, folder, [r["members"] for r in groups.orderBy("group").collect()])


@query(
    "attribution_background",
    f"WITH {EMB}, {BACK} SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id) AS place, "
    "round(list_sum(x),6) AS total FROM emb JOIN bk USING (vec_id)",
)
def attribution_background(spark, folder):
    """The rows that stand for all others."""
    rows = A.background(emb(spark, folder), ["vec_id"], "x", BACKGROUND, SEED)
    return spark.createDataFrame([(i + 1, float(v.sum())) for i, v in enumerate(rows)], "place long, total double").select("place", r6("total"))


@query(
    "permutation_importance",
    f"WITH {TERMS}, ra AS (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS num FROM emb), "
    f"rb AS (SELECT vec_id AS other, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id) AS num FROM emb), "
    "pr AS (SELECT vec_id, other FROM ra JOIN rb USING (num)), mg AS (SELECT vec_id, sum(term) AS m FROM tm GROUP BY vec_id), "
    "fs AS (SELECT unnest(range(0,64)) AS f), "
    "sc AS (SELECT -1 AS f, vec_id, y, round(m,9) AS s FROM mg JOIN emb USING (vec_id) UNION ALL "
    "SELECT fs.f, mg.vec_id, y, round(m-coalesce(a.term,0)+coalesce(b.term,0),9) FROM mg JOIN emb USING (vec_id) JOIN pr USING (vec_id) CROSS JOIN fs "
    "LEFT JOIN tm a ON a.vec_id=mg.vec_id AND a.f=fs.f LEFT JOIN tm b ON b.vec_id=pr.other AND b.f=fs.f), "
    "rk AS (SELECT f, y, rank() OVER (PARTITION BY f ORDER BY s)+(count(*) OVER (PARTITION BY f,s)-1)/2.0::DOUBLE AS r FROM sc), "
    "au AS (SELECT f, (sum(r) FILTER (WHERE y=1)-count(*) FILTER (WHERE y=1)*(count(*) FILTER (WHERE y=1)+1)/2.0::DOUBLE)"
    "/(CAST(count(*) FILTER (WHERE y=1) AS DOUBLE)*count(*) FILTER (WHERE y=0)) AS v FROM rk GROUP BY f) "
    "SELECT CAST(f AS INTEGER) AS feature, round((SELECT v FROM au WHERE f=-1)-v,6)+0.0 AS \"drop\" FROM au WHERE f >= 0",
)
def permutation_importance(spark, folder):
    out = A.permutation_importance(emb(spark, folder), "vec_id", "x", "y", scorer(spark), list(range(64)), SEED)
    return out.select("feature", r6("drop"))


# ---- a small forest, written out --------------------------------------------

# (tree, weight, node, value, left, right, feature, cut); -1 where a node is a leaf
NODES = [
    (0, 1.0, 0, 0.05, 1, 2, 3, 0.0), (0, 1.0, 1, -0.4, 3, 4, 10, 0.05), (0, 1.0, 2, 0.5, -1, -1, -1, 0.0),
    (0, 1.0, 3, -0.7, -1, -1, -1, 0.0), (0, 1.0, 4, 0.2, -1, -1, -1, 0.0),
    (1, 0.1, 0, -0.02, 1, 2, 41, -0.03), (1, 0.1, 1, 0.9, -1, -1, -1, 0.0), (1, 0.1, 2, -0.8, -1, -1, -1, 0.0),
    (2, 0.1, 0, 0.01, 1, 2, 10, 0.1), (2, 0.1, 1, -0.3, 3, 4, 3, -0.1), (2, 0.1, 2, 0.6, 5, 6, 63, 0.0),
    (2, 0.1, 3, -1.1, -1, -1, -1, 0.0), (2, 0.1, 4, 0.4, -1, -1, -1, 0.0), (2, 0.1, 5, 0.2, -1, -1, -1, 0.0), (2, 0.1, 6, 1.3, -1, -1, -1, 0.0),
]


def way_sql(tree: int, leaf, node: int = 0, steps: tuple = ()) -> str:
    """Nested cases down to the leaves; ``leaf`` says what a leaf and the steps to it give."""
    found = {n[2]: n for n in NODES if n[0] == tree}
    _, weight, _, value, left, right, feature, cut_ = found[node]
    if left < 0:
        return leaf(value * weight, steps)
    down = [way_sql(tree, leaf, c, (*steps, (feature, (found[c][3] - value) * weight))) for c in (left, right)]
    return f"(CASE WHEN x[{feature + 1}] <= {cut_!r}::DOUBLE THEN {down[0]} ELSE {down[1]} END)"


def small_forest(spark):
    from seqloom.operators.models import Forest

    kinds = "tree int, weight double, node int, prediction double, left int, right int, feature int, cut double"
    return Forest.of(spark.createDataFrame(NODES, kinds))


TREES = range(3)
FOREST_SUM = "+".join(way_sql(t, lambda v, _: f"({v!r}::DOUBLE)") for t in TREES)
FOREST_STEPS = " || ".join(
    way_sql(t, lambda _, steps: "[" + ",".join(f"{{'f':{f},'d':{d!r}::DOUBLE}}" for f, d in steps) + "]") for t in TREES
)


@query("forest_scores", f"WITH {EMB} SELECT vec_id, round(1/(1+exp(-2*({FOREST_SUM}))),6) AS p FROM emb")
def forest_scores(spark, folder):
    return emb(spark, folder).select("vec_id", r6(small_forest(spark).score("x"), "p"))


@query(
    "forest_attribution",
    f"WITH {EMB}, st AS (SELECT vec_id, label, unnest({FOREST_STEPS}) AS u FROM emb), ct AS (SELECT vec_id, label, u.f AS f, sum(u.d) AS c FROM st GROUP BY 1,2,3), "
    "n AS (SELECT label, count(*) AS n FROM emb GROUP BY label) "
    "SELECT label, CAST(f AS INTEGER) AS feature, round(sum(abs(c))/max(n),6) AS attribution FROM ct JOIN n USING (label) GROUP BY label, f",
)
def forest_attribution(spark, folder):
    """Mean absolute contributions of the features that the forest uses, by label."""
    from seqloom.operators.models import mean_attributions

    out = mean_attributions(emb(spark, folder), "label", "x", small_forest(spark)).filter("total > 0")
    return out.select("label", "feature", r6(F.col("total") / F.col("n"), "attribution"))


@query(
    "residual_gains",
    f"WITH {EMB}, rs AS (SELECT vec_id, y-1/(1+exp(-2*({FOREST_SUM}))) AS r, 1/(1+exp(-2*({FOREST_SUM}))) AS p FROM emb), "
    "en AS (SELECT f, min(v) AS lo, max(v) AS hi FROM lf GROUP BY f), "
    "c AS (SELECT lf.f, least(CAST(floor((v-lo)/(hi-lo)*32) AS INTEGER),31) AS bin, count(*) AS n, sum(-r) AS g, sum(p*(1-p)) AS h FROM lf JOIN en USING (f) JOIN rs USING (vec_id) GROUP BY 1,2), "
    "a AS (SELECT x.f, x.bin, sum(z.n) FILTER (WHERE z.bin<=x.bin) AS ln, sum(z.g) FILTER (WHERE z.bin<=x.bin) AS lg, sum(z.h) FILTER (WHERE z.bin<=x.bin) AS lh, "
    "sum(z.n) AS tn, sum(z.g) AS tg, sum(z.h) AS th FROM c x JOIN c z ON z.f=x.f GROUP BY 1,2) "
    "SELECT CAST(f AS INTEGER) AS feature, round(coalesce(max(lg*lg/lh+(tg-lg)*(tg-lg)/(th-lh)-tg*tg/th) FILTER (WHERE ln>=20 AND tn-ln>=20),0),6) AS gain FROM a GROUP BY f",
)
def residual_gains(spark, folder):
    """What each feature would still explain of what a model leaves over."""
    from seqloom.operators.models import residual_gains as gains

    rows = emb(spark, folder).withColumn("p", small_forest(spark).score("x"))
    return gains(rows, "x", "y", "p").select("feature", r6("gain"))
