"""Queries over folds, metrics, splits, blocks and importances."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.operators import composition as C
from seqloom.operators import folds as K
from seqloom.operators import metrics as M
from seqloom.operators import mutations as U
from seqloom.operators import tables as T
from seqloom.plans.base import ITEMS, LABELED, SEQS, TURNS, items, labeled, query, r6, seqs, turns
from seqloom.session import checkpoint_folder, cut
from seqloom.sources import tables as IO
from seqloom.sources.tables import read_table


def scratch(spark) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_folder(spark).rstrip('/')}/seqloom-{uuid.uuid4().hex}"


# ---- the scored rows every metric reads ------------------------------------

def scored(spark, folder):
    """(doc_id, y, p, fold, yhat); the texts are read once, for p."""
    rows = cut(
        labeled(spark, folder).select("doc_id", F.col("quality").alias("y"), S.class_fraction("seq", "KR").alias("p"))
    )
    rows = K.stratified_folds(rows, ["doc_id"], "y", 10, 42)
    return rows.withColumn("yhat", M.threshold_label("p", 0.08))


KR = "length(regexp_replace(seq,'[^KR]','','g'))/CAST(length(seq) AS DOUBLE)"


def fold_sql(seed: str = "42", by: str = "quality", extra: str = "") -> str:
    return (
        f"(row_number() OVER (PARTITION BY {extra}{by} ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || {seed}), doc_id)-1) % 10"
    )


SCORED = (
    f"{LABELED}, sc AS (SELECT doc_id, quality AS y, {KR} AS p, CAST({fold_sql()} AS INTEGER) AS fold FROM labeled), "
    "score AS (SELECT *, CASE WHEN p >= 0.08 THEN 1 ELSE 0 END AS yhat FROM sc)"
)
CONF = (
    "cm AS (SELECT fold, CAST(count(*) FILTER (WHERE y=0 AND yhat=0) AS BIGINT) AS tn, count(*) FILTER (WHERE y=0 AND yhat=1) AS fp, "
    "count(*) FILTER (WHERE y=1 AND yhat=0) AS fn, count(*) FILTER (WHERE y=1 AND yhat=1) AS tp FROM score GROUP BY fold)"
)
ORZ = "CASE WHEN {b} <> 0 THEN ({t})/CAST({b} AS DOUBLE) ELSE 0 END"
METRIC_SQL = {
    "MCC": "CASE WHEN (tp+fp)=0 OR (tp+fn)=0 OR (tn+fp)=0 OR (tn+fn)=0 THEN 0 ELSE (tp*tn-fp*fn)/(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)) END",
    "F1": ORZ.format(t="2.0*tp", b="(2*tp+fn+fp)"),
    "Fb05": "CASE WHEN tp+fn+fp=0 THEN 0 ELSE 1.25::DOUBLE*tp/(1.25::DOUBLE*tp+0.25::DOUBLE*fn+fp) END",
    "Fb01": "CASE WHEN tp+fn+fp=0 THEN 0 ELSE 1.01::DOUBLE*tp/(1.01::DOUBLE*tp+0.01::DOUBLE*fn+fp) END",
    "ACC": "(tp+tn)/CAST(tp+tn+fp+fn AS DOUBLE)",
    "SN": ORZ.format(t="tp", b="(tp+fn)"),
    "SP": ORZ.format(t="tn", b="(tn+fp)"),
}
# every positive against every negative, instead of ranks
AUC = (
    "auc AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auroc "
    "FROM score a JOIN score b ON a.fold=b.fold AND a.y=1 AND b.y=0 GROUP BY a.fold)"
)


@query("stratified_folds", f"WITH {SCORED} SELECT doc_id, y, fold FROM score")
def stratified_folds(spark, folder):
    return scored(spark, folder).select("doc_id", "y", "fold")


@query(
    "repeated_folds",
    f"WITH {LABELED}, r AS (SELECT doc_id, quality, CAST(unnest([0,1,2]) AS INTEGER) AS \"repeat\" FROM labeled) "
    f"SELECT doc_id, quality AS y, \"repeat\", CAST({fold_sql('CAST(repeat+42 AS VARCHAR)', 'quality', 'repeat, ')} AS INTEGER) AS fold FROM r",
)
def repeated_folds(spark, folder):
    rows = cut(labeled(spark, folder).select("doc_id", F.col("quality").alias("y")))
    return K.repeated_folds(rows, ["doc_id"], "y", 10, 3).select("doc_id", "y", "repeat", "fold")


@query(
    "leave_one_out",
    f"WITH {SEQS} SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':0'), doc_id)-1 AS fold FROM seqs",
)
def leave_one_out(spark, folder):
    return K.leave_one_out(cut(seqs(spark, folder).select("doc_id")), ["doc_id"]).select("doc_id", "fold")


@query(
    "custom_folds",
    f"WITH {SEQS} SELECT s.doc_id, CASE WHEN l.toxic IS NULL THEN NULL ELSE 2*l.quality+l.toxic END AS fold "
    "FROM seqs s LEFT JOIN labels l USING (doc_id)",
)
def custom_folds(spark, folder):
    chosen = read_table(spark, folder, "labels").select("doc_id", (2 * F.col("quality") + F.col("toxic")).alias("fold"))
    return K.custom_folds(seqs(spark, folder).select("doc_id"), chosen, ["doc_id"]).select("doc_id", "fold")


@query("fold_of_row", f"WITH {SCORED} SELECT doc_id, fold+1 AS valid_fold FROM score")
def fold_of_row(spark, folder):
    return K.fold_of_row(scored(spark, folder)).select("doc_id", "valid_fold")


@query("threshold_label", f"WITH {SCORED} SELECT doc_id, round(p,6) AS p, yhat FROM score")
def threshold_label(spark, folder):
    return scored(spark, folder).select("doc_id", r6("p"), "yhat")


@query("confusion", f"WITH {SCORED}, {CONF} SELECT fold, tn, fp, fn, tp FROM cm")
def confusion(spark, folder):
    return M.confusion(scored(spark, folder), ["fold"], "y", "yhat")


def register_metric(name: str, metric: str):
    @query(name, f"WITH {SCORED}, {CONF} SELECT fold, round({METRIC_SQL[metric]},6) AS value FROM cm")
    def run(spark, folder):
        counts = M.confusion(scored(spark, folder), ["fold"], "y", "yhat")
        return counts.select("fold", r6(M.score_by(metric)(), "value"))


for _name, _metric in {
    "accuracy": "ACC", "sensitivity": "SN", "specificity": "SP", "mcc": "MCC", "f1": "F1", "fbeta_half": "Fb05",
    "fbeta_tenth": "Fb01",
}.items():
    register_metric(_name, _metric)


@query("auroc", f"WITH {SCORED}, {AUC} SELECT fold, round(auroc,6) AS auroc FROM auc")
def auroc(spark, folder):
    return M.auroc(scored(spark, folder), ["fold"], "y", "p").select("fold", r6("AUROC", "auroc"))


REPORT_SQL = (
    f"rep AS (SELECT cm.fold, auroc AS AUROC, {', '.join(f'{e} AS {m}' for m, e in METRIC_SQL.items())} "
    "FROM cm LEFT JOIN auc ON auc.fold=cm.fold)"
)


@query(
    "test_report",
    f"WITH {SCORED}, {CONF}, {AUC}, {REPORT_SQL} SELECT fold, {', '.join(f'round({m},6) AS {m}' for m in M.ALL_METRICS)} FROM rep",
)
def test_report(spark, folder):
    rep = M.metric_report(scored(spark, folder), ["fold"], "y", "p", 0.08)
    return rep.select("fold", *[r6(m) for m in M.ALL_METRICS])


@query(
    "fold_summary",
    f"WITH {SCORED}, {CONF}, {AUC}, {REPORT_SQL} SELECT 'Valid' AS dataset, "
    f"{', '.join(f'round(avg({m}),6) AS {m}' for m in M.ALL_METRICS)} FROM rep",
)
def fold_summary(spark, folder):
    rep = M.metric_report(scored(spark, folder), ["fold"], "y", "p", 0.08).withColumn("dataset", F.lit("Valid"))
    return M.fold_summary(rep, M.ALL_METRICS).select("dataset", *[r6(m) for m in M.ALL_METRICS])


@query(
    "cv_mean_std",
    f"WITH {SCORED}, {CONF} SELECT round(avg(m),6) AS mean, round(stddev_samp(m),6) AS std FROM (SELECT {METRIC_SQL['MCC']} AS m FROM cm)",
)
def cv_mean_std(spark, folder):
    counts = M.confusion(scored(spark, folder), ["fold"], "y", "yhat").select(M.mcc().alias("MCC"))
    return M.cv_mean_std(counts, "MCC").select(r6("mean"), r6("std"))


# three stand-in models: three class fractions cut at their own thresholds
MODELS = {"kr": ("KR", 0.08), "de": ("DE", 0.15), "fwy": ("FWY", 0.02)}
MODELS_SQL = (
    f"{LABELED}, sc AS (SELECT doc_id, quality AS y, seq, CAST({fold_sql()} AS INTEGER) AS fold FROM labeled), score AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS model, doc_id, y, fold, CASE WHEN length(regexp_replace(seq,'[^{c}]','','g'))/CAST(length(seq) AS DOUBLE) >= {t} "
        "THEN 1 ELSE 0 END AS yhat FROM sc"
        for n, (c, t) in MODELS.items()
    )
    + "), "
    + CONF.replace("SELECT fold", "SELECT model, fold").replace("GROUP BY fold", "GROUP BY model, fold")
    + f", rep AS (SELECT model, fold, {METRIC_SQL['MCC']} AS MCC, {METRIC_SQL['ACC']} AS ACC FROM cm)"
)


def model_scores(spark, folder):
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("model"), M.threshold_label(S.class_fraction("seq", c), t).alias("yhat"))
            for n, (c, t) in MODELS.items()
        ]
    )
    rows = cut(labeled(spark, folder).select("doc_id", F.col("quality").alias("y"), cells.alias("cells")))
    rows = K.stratified_folds(rows, ["doc_id"], "y", 10, 42).select("doc_id", "y", "fold", F.inline("cells"))
    return M.confusion(rows, ["model", "fold"], "y", "yhat").select(
        "model", "fold", M.mcc().alias("MCC"), M.accuracy().alias("ACC")
    )


@query(
    "model_summary",
    f"WITH {MODELS_SQL} SELECT model, round(avg(MCC),6) AS MCC_mean, round(stddev_pop(MCC),6) AS MCC_std, "
    "round(avg(ACC),6) AS ACC_mean, round(stddev_pop(ACC),6) AS ACC_std FROM rep GROUP BY model",
)
def model_summary(spark, folder):
    out = M.model_summary(model_scores(spark, folder), ["MCC", "ACC"])
    return out.select("model", *[r6(c) for c in out.columns[1:]])


@query(
    "rank_models",
    f"WITH {MODELS_SQL}, a AS (SELECT model, (avg(MCC)+avg(ACC))/2 AS average FROM rep GROUP BY model) "
    "SELECT model, round(average,6) AS average FROM a",
)
def rank_models(spark, folder):
    out = M.rank_models(M.model_summary(model_scores(spark, folder), ["MCC", "ACC"]), ["MCC", "ACC"])
    return out.select("model", r6("average"))


@query(
    "ensemble_average",
    f"WITH {SEQS} SELECT doc_id, round((" + "+".join(
        f"length(regexp_replace(seq,'[^{c}]','','g'))" for c, _ in MODELS.values()
    ) + ")/CAST(length(seq) AS DOUBLE)/3,6) AS p, CAST(3 AS BIGINT) AS models FROM seqs",
)
def ensemble_average(spark, folder):
    df = seqs(spark, folder)
    cells = F.array(*[S.class_fraction("seq", c) for c, _ in MODELS.values()])
    preds = df.select("doc_id", F.explode(cells).alias("p"))
    return M.ensemble_average(preds, ["doc_id"], "p").select("doc_id", r6("p"), "models")


@query(
    "class_balance",
    f"WITH {LABELED} SELECT CASE WHEN d.lang='en' THEN 'train' ELSE 'test' END AS \"Dataset\", quality AS \"CPP\", count(*) AS n_rows "
    "FROM labeled JOIN documents d USING (doc_id) GROUP BY 1,2",
)
def class_balance(spark, folder):
    return M.class_balance(combined(spark, folder), ["Dataset"], "CPP")


@query("class_weight", f"WITH {LABELED} SELECT doc_id, quality AS y, CASE WHEN quality=1 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM labeled")
def class_weight(spark, folder):
    rows = labeled(spark, folder).select("doc_id", F.col("quality").alias("y"))
    return M.class_weight(rows, "y", 0.1)


@query(
    "r2",
    "WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), "
    "s AS (SELECT l.l_returnflag, sum(pow(l_extendedprice-1500.0::DOUBLE*l_quantity,2)) AS e, sum(pow(l_extendedprice-m.m,2)) AS t "
    "FROM lineitem l JOIN m ON m.l_returnflag=l.l_returnflag GROUP BY 1) SELECT l_returnflag, round(greatest(1-e/t,0),6) AS r2 FROM s",
)
def r2(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(
        "l_returnflag", "l_extendedprice", (1500.0 * F.col("l_quantity")).alias("guess")
    )
    return M.r2(rows, ["l_returnflag"], "l_extendedprice", "guess", clip=True).select("l_returnflag", r6("r2"))


@query("scoring", f"WITH {SCORED}, {CONF.replace('SELECT fold,', 'SELECT').replace(' GROUP BY fold', '')}, "
       f"one AS (SELECT {', '.join(f'{e} AS {m}' for m, e in METRIC_SQL.items())} FROM cm), "
       "au AS (SELECT avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS v "
       "FROM score a JOIN score b ON a.y=1 AND b.y=0) SELECT 'AUROC' AS metric, round(v,6) AS value FROM au"
       + "".join(f" UNION ALL SELECT '{m}', round({m},6) FROM one" for m in METRIC_SQL))
def scoring(spark, folder):
    return M.evaluate_all(scored(spark, folder), "y", "p", M.ALL_METRICS, 0.08).select("metric", r6("value"))


@query("custom_metric", f"WITH {SCORED} SELECT 'brier' AS metric, round(avg(pow(y-p,2)),6) AS value FROM score")
def custom_metric(spark, folder):
    def brier(df, label, score):
        return df.agg(F.lit("brier").alias("metric"), F.avg(F.pow(F.col(label) - F.col(score), 2)).alias("value"))

    return M.evaluate(scored(spark, folder), "y", "p", brier).select("metric", r6("value"))


# ---- splits, joins, blocks --------------------------------------------------

def combined(spark, folder):
    """(ID, Sequence, CPP, Dataset) as the sequence and label files give it; English texts train, the others test."""
    return labeled(spark, folder, "lang").select(
        F.col("doc_id").alias("ID"), F.col("seq").alias("Sequence"), F.col("quality").alias("CPP"),
        F.when(F.col("lang") == "en", "train").otherwise("test").alias("Dataset"),
    )


COMBINED = (
    f"{LABELED}, comb AS (SELECT doc_id AS \"ID\", seq AS \"Sequence\", quality AS \"CPP\", "
    "CASE WHEN d.lang='en' THEN 'train' ELSE 'test' END AS \"Dataset\" FROM labeled JOIN documents d USING (doc_id))"
)


@query("tag_split", f"WITH {SEQS} SELECT doc_id, seq, 'train' AS \"Dataset\" FROM seqs")
def tag_split(spark, folder):
    return T.tag_split(seqs(spark, folder), "train")


@query("select_split", f"WITH {COMBINED} SELECT * FROM comb WHERE \"Dataset\"='train'")
def select_split(spark, folder):
    return T.select_split(combined(spark, folder), "train")


@query("select_negatives", f"WITH {COMBINED} SELECT \"ID\", \"Sequence\" FROM comb WHERE \"CPP\"=0")
def select_negatives(spark, folder):
    return T.select_negatives(combined(spark, folder), "CPP", "ID", "Sequence")


@query("union_splits", f"WITH {SEQS}, {ITEMS} SELECT doc_id AS \"ID\", seq AS \"Sequence\", 'train' AS \"Dataset\" FROM seqs UNION ALL SELECT item_id, seq, 'test' FROM items")
def union_splits(spark, folder):
    a = seqs(spark, folder).select(F.col("doc_id").alias("ID"), F.col("seq").alias("Sequence"))
    b = items(spark, folder).select(F.col("item_id").alias("ID"), F.col("seq").alias("Sequence"))
    return T.union_splits(T.tag_split(a, "train"), T.tag_split(b, "test"))


LONG_IDS = (
    "ids AS (SELECT doc_id AS \"ID\", 'train' AS \"Dataset\", seq FROM seqs UNION ALL SELECT item_id, 'test', seq FROM items)"
)


@query(
    "join_descriptor",
    f"WITH {SEQS}, {ITEMS}, {LONG_IDS} SELECT \"ID\", \"Dataset\", length(seq) AS \"Length\", "
    "round(length(regexp_replace(seq,'[^KR]','','g'))/CAST(length(seq) AS DOUBLE),6) AS charge FROM ids",
)
def join_descriptor(spark, folder):
    base = union_splits(spark, folder)
    block = base.select("ID", "Dataset", r6(S.class_fraction("Sequence", "KR"), "charge"))
    return T.join_descriptor(base, block).select("ID", "Dataset", F.length("Sequence").cast("bigint").alias("Length"), "charge")


@query(
    "positional_join",
    f"WITH {LABELED}, a AS (SELECT doc_id, length(seq) AS len, row_number() OVER (ORDER BY doc_id) AS o FROM labeled), "
    "b AS (SELECT quality, row_number() OVER (ORDER BY doc_id) AS o FROM labels) "
    "SELECT a.doc_id, CAST(len AS INTEGER) AS len, quality FROM a JOIN b ON a.o=b.o",
)
def positional_join(spark, folder):
    a = labeled(spark, folder).select("doc_id", F.length("seq").alias("len"))
    b = read_table(spark, folder, "labels").select(F.col("doc_id").alias("place"), "quality")
    return T.positional_join(a, b, ["doc_id"], ["place"]).select("doc_id", "len", "quality")


HALVES = f"{SEQS}, en AS (SELECT s.doc_id, seq, source FROM seqs s JOIN documents d USING (doc_id))"


@query(
    "leakage_check",
    f"WITH {HALVES}, a AS (SELECT * FROM en WHERE source<'src15'), b AS (SELECT * FROM en WHERE source>='src15') "
    "SELECT doc_id, 'shared' AS part FROM a WHERE seq IN (SELECT seq FROM b) "
    "UNION ALL SELECT doc_id, 'own' FROM a WHERE seq NOT IN (SELECT seq FROM b)",
)
def leakage_check(spark, folder):
    rows = seqs(spark, folder, "source")
    train, test = rows.filter("source < 'src15'"), rows.filter("source >= 'src15'")
    part = F.when(F.col("shared"), "shared").otherwise("own")
    return T.leakage(train, test, "seq").select("doc_id", part.alias("part"))


@query("trim", "SELECT doc_id, md5(regexp_replace(regexp_replace(text,'^ +',''),' +$','')) AS digest FROM documents")
def trim(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.md5(F.trim("text")).alias("digest"))


@query("arith", f"WITH {SEQS} SELECT doc_id, CAST(length(regexp_replace(seq,'[^KRH]','','g'))-length(regexp_replace(seq,'[^DE]','','g')) AS INTEGER) AS diff FROM seqs")
def arith(spark, folder):
    df = seqs(spark, folder).select("doc_id", S.count_in("seq", "KRH").alias("a"), S.count_in("seq", "DE").alias("b"))
    return df.select("doc_id", (F.col("a") - F.col("b")).alias("diff"))


# ---- edited pairs: a conversation turn and the next one ---------------------

PAIRS = f"{TURNS}, pairs AS (SELECT a.conv_id, a.turn, a.seq AS a, b.seq AS b FROM turns a JOIN turns b ON b.conv_id=a.conv_id AND b.turn=a.turn+1)"


def pairs(spark, folder):
    rows = turns(spark, folder)
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("seq").alias("b"))
    return rows.withColumnRenamed("seq", "a").join(following, ["conv_id", "turn"])


@query(
    "pairs_to_labeled",
    f"WITH {PAIRS}, p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM pairs) "
    "SELECT 'Negative_' || i AS \"ID\", a AS \"Sequence\", 0 AS \"CPP\", 'Original_nonCPP' AS \"Dataset\" FROM p "
    "UNION ALL SELECT 'Positive_' || i, b, 1, 'Optimized_CPP' FROM p",
)
def pairs_to_labeled(spark, folder):
    return T.pairs_to_labeled(pairs(spark, folder), ["conv_id", "turn"], "a", "b")


@query(
    "union_pairs",
    f"WITH {PAIRS} SELECT a AS \"Original\", b AS \"Optimized\" FROM pairs UNION ALL SELECT b, a FROM pairs",
)
def union_pairs(spark, folder):
    p = pairs(spark, folder)
    one = p.select(F.col("a").alias("Original"), F.col("b").alias("Optimized"))
    return one.unionByName(p.select(F.col("b").alias("Original"), F.col("a").alias("Optimized")))


@query("read_pairs", f"WITH {PAIRS} SELECT a AS \"Original\", b AS \"Optimized\" FROM pairs")
def read_pairs(spark, folder):
    path = scratch(spark)
    p = pairs(spark, folder).select(F.col("a").alias("Original"), F.col("b").alias("Optimized"))
    first = F.crc32("Original") % 2 == 0
    p.filter(first).write.mode("overwrite").csv(path + "/one", header=True)
    p.filter(~first).write.mode("overwrite").csv(path + "/two", header=True)
    return IO.read_pairs(spark, [path + "/one", path + "/two"])


ZIPPED = (
    f"{PAIRS}, z AS (SELECT conv_id, turn, pos, o, m FROM (SELECT conv_id, turn, unnest(range(1, least(length(a),length(b))+1)) AS pos, "
    "unnest(string_split(left(a,least(length(a),length(b))),'')) AS o, unnest(string_split(left(b,least(length(a),length(b))),'')) AS m FROM pairs))"
)
CELLS = "cells AS (SELECT o, m, count(*) AS n FROM z WHERE o <> m GROUP BY o, m)"


@query("zip_positions", f"WITH {ZIPPED} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, o, m FROM z")
def zip_positions(spark, folder):
    return U.zip_positions(pairs(spark, folder), ["conv_id", "turn"], "a", "b")


@query("hamming", f"WITH {ZIPPED} SELECT conv_id, turn, CAST(count(*) FILTER (WHERE o<>m) AS INTEGER) AS d FROM z GROUP BY 1,2")
def hamming(spark, folder):
    return pairs(spark, folder).select("conv_id", "turn", S.hamming("a", "b").alias("d"))


@query(
    "mutation_matrix",
    f"WITH {ZIPPED}, {CELLS} SELECT o, {', '.join(f'CAST(coalesce(sum(CASE WHEN m={chr(39)}{a}{chr(39)} THEN n END),0) AS BIGINT) AS {chr(34)}{a}{chr(34)}' for a in L.LETTERS)} FROM cells GROUP BY o",
)
def mutation_matrix(spark, folder):
    return U.mutation_matrix(pairs(spark, folder), "a", "b")


@query(
    "mutation_share",
    f"WITH {ZIPPED}, {CELLS}, s AS (SELECT o, m, round(100.0::DOUBLE*n/sum(n) OVER (),2) AS share FROM cells) "
    "SELECT o, m, share, round(sum(share) OVER (PARTITION BY o),4) AS row_total, round(sum(share) OVER (PARTITION BY m),4) AS column_total FROM s",
)
def mutation_share(spark, folder):
    out = U.mutation_share(U.mutation_cells(pairs(spark, folder), "a", "b"))
    return out.select("o", "m", "share", F.round("row_total", 4).alias("row_total"), F.round("column_total", 4).alias("column_total"))


# ---- lookups written and read back ------------------------------------------

FREQ = (
    f"{SEQS}, fq AS (SELECT lang AS prop, c AS letter, count(*)*1000.0::DOUBLE/sum(count(*)) OVER (PARTITION BY lang) AS v FROM "
    "(SELECT doc_id, unnest(string_split(seq,'')) AS c FROM seqs) JOIN documents USING (doc_id) GROUP BY lang, c), "
    f"grid AS (SELECT p.prop, l.letter, coalesce(fq.v,0) AS v FROM (SELECT DISTINCT prop FROM fq) p CROSS JOIN (SELECT unnest(string_split('{L.LETTERS}','')) AS letter) l "
    "LEFT JOIN fq ON fq.prop=p.prop AND fq.letter=l.letter)"
)


def letter_rates(spark, folder):
    """(prop, letter, value): letters per thousand in each language, all 20 cells."""
    df = seqs(spark, folder, "lang")
    counts = df.select("lang", *[S.count_in("seq", a).cast("double").alias(a) for a in L.LETTERS])
    sums = counts.groupBy(F.col("lang").alias("prop")).agg(*[F.sum(a).alias(a) for a in L.LETTERS])
    whole = sum((F.col(a) for a in L.LETTERS[1:]), F.col(L.LETTERS[0]))
    return sums.select(
        "prop",
        F.inline(F.array(*[F.struct(F.lit(a).alias("letter"), (F.col(a) * 1000.0 / whole).alias("value")) for a in L.LETTERS])),
    )


def standardize_lookup(df):
    """(v - mean) / population deviation within each property; 20 rows per property."""
    from pyspark.sql import Window as W

    w = W.partitionBy("prop")
    return df.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))


@query("standardize_lookup", f"WITH {FREQ} SELECT prop, letter, round((v-avg(v) OVER (PARTITION BY prop))/stddev_pop(v) OVER (PARTITION BY prop),6) AS value FROM grid")
def standardize(spark, folder):
    return standardize_lookup(letter_rates(spark, folder)).select("prop", "letter", r6("value"))


@query("read_lookup", f"WITH {FREQ} SELECT prop, letter, round(v,6) AS value FROM grid")
def read_lookup(spark, folder):
    path = scratch(spark)
    IO.write_lookup(letter_rates(spark, folder), path, L.LETTERS)
    return IO.read_lookup(spark, path, L.LETTERS).select("prop", "letter", r6("value"))


@query("read_labels", "SELECT quality AS \"CPP\", count(*) AS n_rows FROM labels GROUP BY quality")
def read_labels(spark, folder):
    path = scratch(spark)
    read_table(spark, folder, "labels").select(F.col("quality").alias("CPP")).write.mode("overwrite").csv(path, header=True)
    return IO.read_labels(spark, path).groupBy("CPP").agg(F.count("*").alias("n_rows"))


@query("read_sequences", f"WITH {SEQS} SELECT 'D' || doc_id AS \"ID\", md5(seq) AS digest FROM seqs")
def read_sequences(spark, folder):
    from seqloom.sources.fasta import read_sequences as read, write_sequences as write

    path = scratch(spark)
    write(seqs(spark, folder).select(F.concat(F.lit("D"), "doc_id").alias("ID"), F.col("seq").alias("Sequence")), path)
    return read(spark, path).select("ID", F.md5("Sequence").alias("digest"))


# ---- importances: per-fold differences between class means ------------------

def importances(spark, folder):
    """(fold, feature, importance): how far the class means of each letter's share lie apart."""
    cells = F.array(*[F.struct(F.lit(a).alias("feature"), S.class_fraction("seq", a).alias("x")) for a in L.LETTERS])
    rows = cut(labeled(spark, folder).select("doc_id", F.col("quality").alias("y"), cells.alias("cells")))
    long = K.stratified_folds(rows, ["doc_id"], "y", 10, 42).select("fold", "y", F.inline("cells"))
    gap = F.avg(F.when(F.col("y") == 1, F.col("x"))) - F.avg(F.when(F.col("y") == 0, F.col("x")))
    # letters that tell little apart count as unused in that fold
    size = F.floor(F.coalesce(F.abs(gap), F.lit(0.0)) * 40)
    return cut(long.groupBy("fold", "feature").agg(size.cast("double").alias("importance")))


IMPORTANCE = (
    f"{LABELED}, f AS (SELECT seq, quality AS y, CAST({fold_sql()} AS INTEGER) AS fold FROM labeled), "
    f"x AS (SELECT fold, y, letter AS feature, (length(seq)-length(replace(seq,letter,'')))/CAST(length(seq) AS DOUBLE) AS x FROM f "
    f"CROSS JOIN (SELECT unnest(string_split('{L.LETTERS}','')) AS letter)), "
    "imp AS (SELECT fold, feature, CAST(floor(coalesce(abs(avg(x) FILTER (WHERE y=1)-avg(x) FILTER (WHERE y=0)),0)*40) AS DOUBLE) AS importance "
    "FROM x GROUP BY fold, feature), su AS (SELECT feature, avg(importance) AS mean, stddev_samp(importance) AS std FROM imp GROUP BY feature)"
)


@query("importance_join", f"WITH {IMPORTANCE} SELECT feature, " + ", ".join(
    f"max(CASE WHEN fold={f} THEN importance END) AS \"Fold{f + 1}\"" for f in range(10)) + " FROM imp GROUP BY feature")
def importance_join(spark, folder):
    return M.importance_by_fold(importances(spark, folder), range(10))


@query("importance_summary", f"WITH {IMPORTANCE} SELECT feature, round(mean,6) AS mean, round(std,6) AS std FROM su")
def importance_summary(spark, folder):
    return M.importance_summary(importances(spark, folder)).select("feature", r6("mean"), r6("std"))


@query("top_features", f"WITH {IMPORTANCE} SELECT feature, round(mean,6) AS mean FROM su ORDER BY su.mean DESC, feature LIMIT 8")
def top_features(spark, folder):
    return M.top_features(M.importance_summary(importances(spark, folder)), 8).select("feature", r6("mean"))


@query("drop_irrelevant", f"WITH {IMPORTANCE} SELECT feature FROM su WHERE mean <> 0")
def drop_irrelevant(spark, folder):
    imp = importances(spark, folder)
    return T.feature_difference(imp.select("feature").distinct(), M.irrelevant_features(imp))


@query("best_row", f"WITH {IMPORTANCE} SELECT feature, mean FROM su ORDER BY mean DESC, feature LIMIT 1")
def best_row(spark, folder):
    return M.best_row(M.importance_summary(importances(spark, folder)), "feature", "mean")
