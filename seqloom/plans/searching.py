"""Queries over candidate populations and the search log."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from seqloom.functions import flat
from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.operators import mutations as U
from seqloom.operators import search as G
from seqloom.operators import selected as X
from seqloom.operators import tables as T
from seqloom.plans.base import NAMES, cleaned, distance_sql, props_sql, query, r6
from seqloom.plans.modelling import scratch
from seqloom.session import spread_keys
from seqloom.sources import tables as IO
from seqloom.sources.tables import read_table

HYDRO = {"h": L.property_rows()["Hydrophobicity"]}


#: Targets that one task searches; a target's candidates stay in its task.
TARGETS_AT_ONCE = 4000


def targets(spark, folder):
    """(target_id, target): every part name, dealt by target, so that ranks and bests of its candidates move nothing.

    The names are dealt before they are cleaned: a file of parts may be a single split.
    """
    rows = read_table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), "p_name")
    return cleaned(spread_keys(rows, "target_id", TARGETS_AT_ONCE), "p_name", "target_id").withColumnRenamed("seq", "target")


def stand_in_scores():
    """p, outlier, distance, n_diff and fitness of single replacements, in the task that makes them."""
    distances = G.similarity_distances()

    def of(rows: pa.RecordBatch) -> list[pa.Array]:
        target, seq = rows.column("target"), rows.column("seq")
        n = np.diff(flat.flat(seq)[1])
        p = np.minimum(1.0, 4 * (flat.count_in(seq, "KR") / n))
        outlier = 1 + np.abs(flat.letter_total(seq, HYDRO["h"], 0.0).to_numpy() / n)
        distance = distances(target, seq, rows.column("self_score"))
        fitness = flat.half_up(G.fitness(distance.to_numpy(zero_copy_only=False), p, outlier), 9)
        return [
            pa.array(flat.half_up(p, 9)), pa.array(flat.half_up(outlier, 9)), distance, flat.differing(target, seq),
            pa.array(fitness, from_pandas=True),
        ]

    kinds = {"p": DoubleType(), "outlier": DoubleType(), "distance": DoubleType(), "n_diff": IntegerType(), "fitness": DoubleType()}
    return G.BatchScores([StructField(k, t) for k, t in kinds.items()], of)


def candidates(spark, folder):
    """Single replacements of every target with stand-in scores; the replaced place numbers the generation."""
    rows = targets(spark, folder).withColumn("self_score", G.alignment_score("target", "target"))
    return G.variants_single(rows, stand_in_scores()).select(
        "target_id", "target", "self_score", F.col("pos").alias("generation"), "seq",
        (20 * F.col("pos") + F.instr(F.lit(L.LETTERS), F.col("letter"))).alias("member"),
        "p", "outlier", "distance", "n_diff", "fitness",
    )


def self_scored(spark, folder):
    """(target_id, target, self_score), before the targets become many: nothing but the names is moved."""
    rows = G.with_each(targets(spark, folder).withColumn("_other", F.col("target")), "_other")
    return rows.select("target_id", "target", G.alignment_score("_other", "_other").alias("self_score"))


CAND = (
    f"{NAMES}, {props_sql(HYDRO, 'hy')}, {distance_sql()}, "
    "ch AS (SELECT p_partkey AS t, seq, length(seq) AS n, unnest(string_split(seq,'')) AS c, unnest(range(1,length(seq)+1)) AS pos FROM names), "
    "base AS (SELECT t, max(seq) AS target, max(n) AS n, sum(v) AS hs, 100.0::DOUBLE*max(n) AS self, "
    "sum(CASE WHEN c IN ('K','R') THEN 1 ELSE 0 END) AS kr FROM ch JOIN hy ON letter=c GROUP BY t), "
    f"al AS (SELECT unnest(string_split('{L.LETTERS}','')) AS l, unnest(range(1,21)) AS li), "
    "va AS (SELECT ch.t, base.target, ch.pos, al.l, li, left(base.target,CAST(ch.pos-1 AS INTEGER)) || al.l || substr(base.target,CAST(ch.pos+1 AS INTEGER)) AS seq, base.n, "
    "(hs-ho.v+hn.v)/base.n AS hm, (kr-CASE WHEN ch.c IN ('K','R') THEN 1 ELSE 0 END+CASE WHEN al.l IN ('K','R') THEN 1 ELSE 0 END)/CAST(base.n AS DOUBLE) AS krf, "
    "dist.d/self AS distance FROM ch JOIN base USING (t) JOIN al ON al.l<>ch.c JOIN hy ho ON ho.letter=ch.c JOIN hy hn ON hn.letter=al.l "
    "JOIN dist ON dist.a=ch.c AND dist.b=al.l), "
    "cb AS (SELECT t, target, pos, li, l, seq, distance, least(1.0::DOUBLE,4*krf) AS p, 1+abs(hm) AS outlier FROM va), "
    "cand AS (SELECT t AS target_id, target, CAST(pos AS INTEGER) AS generation, CAST(20*pos+li AS INTEGER) AS member, seq, distance, round(p,9) AS p, round(outlier,9) AS outlier, "
    "1 AS n_diff, round(distance+greatest((1-p)*(1-p)-0.04::DOUBLE,0)+greatest(outlier*outlier-2.25::DOUBLE,0),9) AS fitness FROM cb)"
)


@query("variants_single", f"WITH {CAND} SELECT t AS target_id, CAST(pos AS INTEGER) AS pos, l AS letter, seq FROM cb")
def variants_single(spark, folder):
    return G.variants_single(targets(spark, folder)).select("target_id", "pos", "letter", "seq")


@query("similarity", f"WITH {CAND} SELECT target_id, member, round(distance,6) AS distance FROM cand")
def similarity(spark, folder):
    return candidates(spark, folder).select("target_id", "member", r6("distance"))


@query("fitness", f"WITH {CAND} SELECT target_id, member, round(fitness,6) AS fitness, n_diff FROM cand")
def fitness(spark, folder):
    return candidates(spark, folder).select("target_id", "member", r6("fitness"), "n_diff")


@query(
    "fitness_weights",
    f"WITH {CAND} SELECT target_id, member, round(2*distance+0.5::DOUBLE*greatest((1-p)*(1-p)-0.04::DOUBLE,0)"
    "+0.25::DOUBLE*greatest(outlier*outlier-2.25::DOUBLE,0),6) AS fitness FROM cand",
)
def fitness_weights(spark, folder):
    return candidates(spark, folder).select(
        "target_id", "member", r6(G.fitness("distance", "p", "outlier", 2.0, 0.5, 0.25), "fitness")
    )


PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fitness, seq, member) AS place FROM cand)"


@query("sort_population", f"WITH {CAND}, {PLACED} SELECT target_id, member, CAST(place AS INTEGER) AS place FROM pl")
def sort_population(spark, folder):
    return G.ranked(candidates(spark, folder)).select("target_id", "member", "place")


SIZED = "SELECT target_id AS t, count(*) AS size FROM cand GROUP BY 1"


@query(
    "elite",
    f"WITH {CAND}, {PLACED} SELECT target_id, member, CAST(place AS INTEGER) AS place FROM pl "
    f"JOIN ({SIZED}) s ON s.t=pl.target_id WHERE place*10 <= size",
)
def elite(spark, folder):
    return G.elite(candidates(spark, folder), 10).select("target_id", "member", "place")


@query(
    "best_per_distance",
    f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id, n_diff ORDER BY fitness, seq) AS r FROM cand) "
    "SELECT target_id, n_diff, seq, round(fitness,6) AS fitness FROM r WHERE r=1",
)
def best_per_distance(spark, folder):
    return G.best_per_distance(candidates(spark, folder)).select("target_id", "n_diff", "seq", r6("fitness"))


LOGGED = (
    "lr AS (SELECT *, row_number() OVER (PARTITION BY target_id, generation ORDER BY fitness, seq) AS r FROM cand), "
    "log AS (SELECT target_id, target, generation, fitness, seq, p, outlier, n_diff FROM lr WHERE r=1)"
)


def search_log(spark, folder):
    rows = candidates(spark, folder)
    log = G.generation_log(rows)
    # a target with a letter has candidates
    named = targets(spark, folder).filter("target <> ''").distinct()
    return log.join(named.hint("shuffle_hash"), "target_id")


@query(
    "generation_log",
    f"WITH {CAND}, {LOGGED} SELECT target_id, generation, seq, round(fitness,6) AS fitness, round(p,6) AS p, round(outlier,6) AS outlier, n_diff FROM log",
)
def generation_log(spark, folder):
    return G.generation_log(candidates(spark, folder)).select(
        "target_id", "generation", "seq", r6("fitness"), r6("p"), r6("outlier"), "n_diff"
    )


@query(
    "stop_rule",
    f"WITH {CAND}, {LOGGED} SELECT target_id, generation FROM log WHERE (p > 0.95 AND outlier < 1.3 AND n_diff <= 1) OR n_diff = 0",
)
def stop_rule(spark, folder):
    return G.generation_log(candidates(spark, folder)).filter(G.has_stopped()).select("target_id", "generation")


@query(
    "unfinished",
    f"WITH {CAND}, {LOGGED} SELECT DISTINCT target_id FROM cand WHERE target_id NOT IN "
    "(SELECT target_id FROM log WHERE (p > 0.95 AND outlier < 1.3 AND n_diff <= 1) OR n_diff = 0)",
)
def unfinished(spark, folder):
    rows = candidates(spark, folder)
    return G.unfinished(rows, G.generation_log(rows)).select("target_id").distinct()


@query(
    "drop_incomplete",
    f"WITH {CAND}, {LOGGED}, g AS (SELECT t AS target_id, CAST(unnest(range(1,(SELECT max(n)+1 FROM base))) AS INTEGER) AS generation FROM base) "
    "SELECT g.target_id, g.generation, round(fitness,6) AS fitness FROM g JOIN log ON log.target_id=g.target_id AND log.generation=g.generation",
)
def drop_incomplete(spark, folder):
    rows = targets(spark, folder)
    longest = rows.agg(F.max(F.length("target"))).first()[0] or 1
    grid = T.product_grid(rows.select("target_id"), longest)
    log = G.generation_log(candidates(spark, folder)).select("target_id", "generation", r6("fitness"))
    # by size of its file the log would pass for small and be sent to the driver
    return U.drop_incomplete(grid.join(log.hint("merge"), ["target_id", "generation"], "left"))


@query("product_grid", f"WITH {NAMES} SELECT p_partkey AS target_id, CAST(unnest(range(1,51)) AS INTEGER) AS generation FROM names")
def product_grid(spark, folder):
    return T.product_grid(targets(spark, folder).select("target_id"), 50)


@query("at_generation", f"WITH {CAND}, {LOGGED} SELECT target_id, seq, round(fitness,6) AS fitness FROM log WHERE generation=5")
def at_generation(spark, folder):
    return U.at_generation(search_log(spark, folder), 5).select("target_id", "seq", r6("fitness"))


@query(
    "last_generation",
    f"WITH {CAND}, {LOGGED} SELECT target_id, generation, seq FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY generation DESC)=1",
)
def last_generation(spark, folder):
    return U.last_generation(search_log(spark, folder)).select("target_id", "generation", "seq")


@query(
    "log_mutations",
    f"WITH {CAND}, {LOGGED}, e AS (SELECT substr(target,generation,1) AS o, substr(seq,generation,1) AS m FROM log) "
    "SELECT o, m, count(*) AS n FROM e WHERE o<>m GROUP BY o, m",
)
def log_mutations(spark, folder):
    return U.mutation_cells(search_log(spark, folder), "target", "seq")


@query("write_results", f"WITH {CAND}, {LOGGED} SELECT generation, count(*) AS n_rows, round(sum(fitness),4) AS total FROM log GROUP BY generation")
def write_results(spark, folder):
    path = scratch(spark)
    IO.write_results(search_log(spark, folder), path, "generation")
    rows = spark.read.parquet(path)
    return rows.groupBy("generation").agg(F.count("*").alias("n_rows"), F.round(F.sum("fitness"), 4).alias("total"))


# ---- seeded choices ---------------------------------------------------------

SIZES = replace(G.SearchSettings(), population=50, generations=3, parents=10)
CHILDREN = G.SearchSettings().population * (100 - G.SearchSettings().elite_percent) // 100


def dice_sql(parts: str, first: int, sides: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({parts}),{first},8) AS BIGINT) % {sides} AS INTEGER)"


def salted(*parts) -> str:
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


def variants_sql(size: int, seed: int = 42) -> str:
    """CTE ``first``: (target_id, target, member, seq)."""
    key = salted("target_id", "member", "j", seed)
    at = f"({dice_sql(key, 1, 'length(target)')}+1)"
    old = f"strpos('{L.LETTERS}', substr(acc,{at},1))"
    letter = f"substr('{L.LETTERS}', CAST(({old}-1+{dice_sql(key, 9, '19')}+1)%20+1 AS INTEGER), 1)"
    return (
        f"first AS (SELECT target_id, target, member, list_reduce(list_prepend(target, list_transform(range(1,length(target)//2+1), lambda q: CAST(q AS VARCHAR))), "
        f"lambda acc, j: left(acc,{at}-1) || {letter} || substr(acc,{at}+1)) AS seq "
        f"FROM (SELECT p_partkey AS target_id, seq AS target, unnest(range(1,{size + 1})) AS member FROM names))"
    )


def couples_sql(ranked: str, children: int, pool: int, generation: int, seed: int = 42) -> str:
    """A table expression (target_id, target, member, first, second) from the rows of a CTE that has ``place``."""
    key = lambda side: salted("c.target_id", "c.member", generation, seed, side)
    return (
        f"SELECT c.target_id, c.target, c.member, x.seq AS first, y.seq AS second FROM (SELECT target_id, any_value(target) AS target, least(count(*),{pool}) AS pool, "
        f"unnest(range(1,{children + 1})) AS member FROM {ranked} GROUP BY target_id) c "
        f"JOIN {ranked} x ON x.target_id=c.target_id AND x.place={dice_sql(key(1), 1, 'c.pool')}+1 "
        f"JOIN {ranked} y ON y.target_id=c.target_id AND y.place={dice_sql(key(2), 1, 'c.pool')}+1"
    )


def child_sql(*salt) -> str:
    key = salted(*salt, "i")
    luck = dice_sql(key, 1, "100")
    letter = f"substr('{L.LETTERS}',{dice_sql(key, 9, '20')}+1,1)"
    return (
        "array_to_string(list_transform(range(0,least(length(first),length(second))), lambda i: "
        f"CASE WHEN {luck} < 45 THEN substr(first,CAST(i+1 AS INTEGER),1) WHEN {luck} < 90 THEN substr(second,CAST(i+1 AS INTEGER),1) ELSE {letter} END),'')"
    )


@query("variants_random", f"WITH {NAMES}, {variants_sql(50)} SELECT target_id, target, member, seq FROM first")
def variants_random(spark, folder):
    return G.variants_random(targets(spark, folder), 50, 50).withColumn("member", F.col("member").cast("long"))


@query("parents", f"WITH {CAND}, {PLACED} SELECT target_id, member, first, second FROM ({couples_sql('pl', CHILDREN, 50, 1)})")
def parents(spark, folder):
    rows = candidates(spark, folder).withColumn("initial_p", F.lit(0.0))
    out = G.parents(rows, CHILDREN, 50, 1, 42)
    return out.select("target_id", F.col("member").cast("long").alias("member"), "first", "second")


@query(
    "crossover",
    f"WITH {CAND}, {PLACED} SELECT target_id, member, {child_sql('target_id', 'member')} AS seq FROM ({couples_sql('pl', SIZES.population, 50, 1)})",
)
def crossover(spark, folder):
    rows = candidates(spark, folder).withColumn("initial_p", F.lit(0.0))
    couples = G.parents(rows, SIZES.population, 50, 1, 42)
    child = G.crossover(F.col("first"), F.col("second"), F.col("target_id"), F.col("member"))
    return couples.select("target_id", F.col("member").cast("long").alias("member"), child.alias("seq"))


# scores that SQL can say: the share of two letters, and the mean of one property

def share_featurize(df):
    return df.withColumn("features", F.array(S.class_fraction("seq", "KR"), F.try_divide(S.letter_sum("seq", HYDRO["h"], batched=True), F.length("seq"))))


def share_predict(df):
    return df.withColumn("p", F.round(F.least(F.lit(1.0), 4 * F.get("features", F.lit(0))), 9))


def share_outlier(df):
    return df.withColumn("outlier", F.round(1 + F.abs(F.get("features", F.lit(1))), 9))


def rounded_objective(settings):
    return F.round(G.weighted_objective(settings), 9)


def scored_sql(source: str) -> str:
    """(target_id, target, member, seq, p, outlier, distance, n_diff, fitness) of the rows of a CTE."""
    return (
        "SELECT *, round(distance+greatest((1-p)*(1-p)-0.04::DOUBLE,0)+greatest(outlier*outlier-2.25::DOUBLE,0),9) AS fitness FROM ("
        "SELECT target_id, any_value(target) AS target, member, any_value(seq) AS seq, round(least(1.0::DOUBLE,4*sum(CASE WHEN s IN ('K','R') THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE)),9) AS p, "
        "round(1+abs(sum(v)/count(*)),9) AS outlier, sum(d)/(100.0::DOUBLE*count(*)) AS distance, CAST(sum(CASE WHEN s<>t THEN 1 ELSE 0 END) AS INTEGER) AS n_diff, row "
        f"FROM (SELECT target_id, target, member, seq, row_number() OVER () AS row, unnest(string_split(seq,'')) AS s, unnest(string_split(target,'')) AS t FROM {source}) "
        "JOIN hy ON letter=s JOIN dist ON a=t AND b=s GROUP BY target_id, member, row)"
    )


LOOKUPS = f"{NAMES}, {props_sql(HYDRO, 'hy')}, {distance_sql()}"


@query(
    "score_variants",
    f"WITH {LOOKUPS}, {variants_sql(20)}, sc AS ({scored_sql('first')}) SELECT target_id, member, seq, round(p,6) AS p, round(outlier,6) AS outlier, round(distance,6) AS distance, n_diff, round(fitness,6) AS fitness FROM sc",
)
def score_variants(spark, folder):
    """Candidates under scores that SQL can say."""
    drawn = G.variants_random(self_scored(spark, folder), 20)
    out = G.score_candidates(drawn, share_featurize, share_predict, share_outlier, objective=rounded_objective)
    return out.select("target_id", F.col("member").cast("long").alias("member"), "seq", r6("p"), r6("outlier"), r6("distance"), "n_diff", r6("fitness"))


@query(
    "objective_variants",
    f"WITH {LOOKUPS}, {variants_sql(20)}, sc AS ({scored_sql('first')}) SELECT target_id, member, round(2*distance-p,6) AS fitness FROM sc",
)
def objective_variants(spark, folder):
    """The same under an objective of the caller's own."""
    drawn = G.variants_random(self_scored(spark, folder), 20)
    own = lambda settings: settings.w1 * F.col("distance") - F.col("p")
    out = G.score_candidates(drawn, share_featurize, share_predict, share_outlier, replace(G.SearchSettings(), w1=2.0), own)
    return out.select("target_id", F.col("member").cast("long").alias("member"), r6("fitness"))


def evolved_sql(settings: G.SearchSettings) -> str:
    """Populations pop1, pop2, ... and their logs log1, log2, ..."""
    children = settings.population * (100 - settings.elite_percent) // 100
    stopped = f"(p > {settings.stop_score} AND outlier < {settings.stop_outlier} AND n_diff <= {settings.stop_diff}) OR n_diff = 0"
    out = [f"{LOOKUPS}, {variants_sql(settings.population, settings.seed)}, all1 AS ({scored_sql('first')})"]
    columns = "target_id, target, member, seq, p, outlier, distance, n_diff, fitness"
    for g in range(1, settings.generations + 1):
        out.append(f"led{g} AS (SELECT * FROM all{g} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY fitness, seq, p, outlier, n_diff)=1)")
        out.append(f"pop{g} AS (SELECT {columns}, row_number() OVER (PARTITION BY target_id ORDER BY fitness, seq, member) AS place FROM all{g} "
                   f"WHERE target_id NOT IN (SELECT target_id FROM led{g} WHERE {stopped}))")
        out.append(f"log{g} AS (SELECT {g} AS generation, * FROM pop{g} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY fitness, seq, p, outlier, n_diff)=1)")
        if g < settings.generations:
            out.append(f"born{g} AS (SELECT target_id, target, member, {child_sql('target_id', 'member', g, settings.seed)} AS seq "
                       f"FROM ({couples_sql(f'pop{g}', children, settings.parents, g, settings.seed)}))")
            out.append(f"all{g + 1} AS (SELECT {columns} FROM pop{g} JOIN (SELECT target_id AS t, count(*) AS size FROM pop{g} GROUP BY 1) z ON z.t=target_id "
                       f"WHERE place*100 <= size*{settings.elite_percent} UNION ALL SELECT {columns} FROM ({scored_sql(f'born{g}')}))")
    return ", ".join(out)


@query(
    "evolve_variants",
    f"WITH {evolved_sql(SIZES)} "
    + " UNION ALL ".join(
        f"SELECT target_id, target, generation, seq, round(fitness,6) AS fitness, round(p,6) AS p, round(outlier,6) AS outlier, n_diff FROM log{g}"
        for g in range(1, SIZES.generations + 1)
    ),
)
def evolve_variants(spark, folder):
    """Generations under scores that SQL can say: ranks, elite, parents, children, stopping rule."""
    found = G.evolve(targets(spark, folder), share_featurize, share_predict, share_outlier, SIZES, rounded_objective)
    return found.log.select("target_id", "target", "generation", "seq", r6("fitness"), r6("p"), r6("outlier"), "n_diff")


# ---- searches with trained models: rows only --------------------------------

SMALL = replace(G.SearchSettings(), population=20, generations=3, parents=10)


def trained(spark, folder):
    """predict and outlier functions from the labeled texts, learned with the trainer's default settings."""
    from seqloom.plans.training import labeled_vectors
    from seqloom.operators import models as B

    rows = labeled_vectors(spark, folder)
    model = B.train_stumps(rows, "features", "y", B.BoostSettings())
    forest = B.Forest.of(B.tree_nodes(spark, model, scratch(spark)))

    def predict(df):
        return df.withColumn("p", forest.score("features"))

    return predict, G.outlier_column(rows, "doc_id", "features")


@query("score_candidates")
def score_candidates(spark, folder):
    predict, outlier = trained(spark, folder)
    drawn = G.variants_random(self_scored(spark, folder), 5)
    out = G.score_candidates(drawn, X.counted_vector, predict, outlier)
    return out.select("target_id", "member", "seq", "p", "outlier", "distance", "n_diff", "fitness")


@query("objective")
def objective(spark, folder):
    """The same scoring under an objective of the caller's own."""
    predict, outlier = trained(spark, folder)
    drawn = G.variants_random(self_scored(spark, folder), 5)
    own = lambda settings: settings.w1 * F.col("distance") - F.col("p")
    return G.score_candidates(drawn, X.counted_vector, predict, outlier, objective=own).select("target_id", "member", "fitness")


@query("evolve")
def evolve(spark, folder):
    predict, outlier = trained(spark, folder)
    found = G.evolve(targets(spark, folder), X.counted_vector, predict, outlier, SMALL)
    return found.log.select("target_id", "target", "generation", "initial_p", "seq", "fitness", "p", "outlier", "n_diff")
