"""Queries over all descriptor blocks: one read of the texts, joined rows, the store, and the names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.operators import blocks as B
from seqloom.operators import tables as T
from seqloom.plans.base import distance_sql, props_sql, query, r6, values
from seqloom.plans.modelling import COMBINED, combined, scratch
from seqloom.session import spread_rows

KEYS = ["ID", "Dataset"]
KEY = '"ID", "Dataset"'
SOME = ("AAC", "DPC", "CTDC")
STD = L.standardized_rows()
RAW = L.property_rows()
BUCKETS = 8


# ---- every block in SQL -----------------------------------------------------

def digits(expr: str, classes) -> str:
    source = "".join(classes)
    return f"translate({expr},'{source}','{''.join(str(i) * len(m) for i, m in enumerate(classes, 1))}')"


def group_values(groups: dict[str, str], name: str) -> str:
    return values([(g, i, a) for i, (g, m) in enumerate(groups.items(), 1) for a in m], "g, i, letter", name)


CLASS_VALUES = values([(c, i, a) for c, three in L.THREE_CLASSES.items() for i, m in enumerate(three, 1) for a in m], "c, i, letter", "cls")
Z_ROWS = {f"z{i + 1}": {a: z[i] for a, z in L.ZSCALES.items()} for i in range(5)}
MATRIX = {b: {a: L.similarity_scores()[a, b] for a in L.LETTERS} for b in L.LETTERS}
CODONS = values([(a, int(n)) for a, n in L.CODONS.items()], "a, k", "codons")

#: What the blocks are made of: letters with those up to 11 places on, pair and letter counts, and the lookups.
BASE = (
    f"{COMBINED}, {props_sql(STD)}, {props_sql(RAW, 'raw')}, {props_sql(Z_ROWS, 'zs')}, {props_sql(MATRIX, 'mat')}, {CODONS}, {distance_sql()}, "
    f"{group_values(L.FIVE_GROUPS, 'five')}, {group_values(L.SEVEN_GROUPS, 'seven')}, {CLASS_VALUES}, "
    f"bc AS MATERIALIZED (SELECT {KEY}, length(\"Sequence\") AS n, unnest(string_split(\"Sequence\",'')) AS c, "
    "unnest(range(1,length(\"Sequence\")+1)) AS pos FROM comb WHERE \"Sequence\" <> ''), "
    f"w AS MATERIALIZED (SELECT *, {', '.join(f'lead(c,{d}) OVER o AS c{d}' for d in range(1, 12))} FROM bc WINDOW o AS (PARTITION BY {KEY} ORDER BY pos)), "
    "p AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {KEY}, n, {d} AS lag, c AS a, c{d} AS b, count(*) AS k FROM w WHERE c{d} IS NOT NULL GROUP BY ALL" for d in range(1, 12)
    ) + f"), l AS MATERIALIZED (SELECT {KEY}, n, c AS a, count(*) AS k FROM bc GROUP BY ALL), "
    f"st AS (SELECT {KEY}, max(n) AS n, prop, sum(k*v)/max(n) AS m, sum(k*v*v)-max(n)*(sum(k*v)/max(n))*(sum(k*v)/max(n)) AS spread "
    f"FROM l JOIN props ON letter=a GROUP BY {KEY}, prop), "
    f"co AS (SELECT p.\"ID\", p.\"Dataset\", p.lag, x.prop AS pa, y.prop AS pb, sum(k*(x.v-s.m)*(y.v-u.m))/max(p.n-p.lag) AS t "
    "FROM p JOIN props x ON x.letter=p.a JOIN props y ON y.letter=p.b "
    "JOIN st s ON s.\"ID\"=p.\"ID\" AND s.\"Dataset\"=p.\"Dataset\" AND s.prop=x.prop JOIN st u ON u.\"ID\"=p.\"ID\" AND u.\"Dataset\"=p.\"Dataset\" AND u.prop=y.prop "
    "WHERE p.lag <= 4 GROUP BY 1,2,3,4,5), "
    f"cp AS (SELECT {KEY}, n, lag, sum(k*d*d) AS total FROM p JOIN dist ON dist.a=p.a AND dist.b=p.b WHERE lag <= 5 GROUP BY ALL), "
    f"qo AS (SELECT {KEY}, 1+0.05::DOUBLE*sum(total) AS base FROM cp WHERE lag <= 3 GROUP BY ALL), "
    f"th AS (SELECT p.\"ID\", p.\"Dataset\", x.prop, sum(k*(x.v-y.v)*(x.v-y.v))/max(p.n-1) AS q, sum(k*x.v*y.v)/max(p.n-1) AS t "
    "FROM p JOIN props x ON x.letter=p.a JOIN props y ON y.letter=p.b AND y.prop=x.prop WHERE lag=1 GROUP BY 1,2,3), "
    f"pa AS (SELECT {KEY}, 0.05::DOUBLE*avg(q) AS t FROM th GROUP BY ALL), "
    f"ap AS (SELECT {KEY}, 1+0.05::DOUBLE*sum(t) AS base FROM th WHERE prop IN ('{list(STD)[0]}','{list(STD)[1]}') GROUP BY ALL), "
    "en AS (SELECT \"ID\", \"Dataset\", left(\"Sequence\",1) || right(\"Sequence\",5) AS seq FROM comb WHERE \"Sequence\" <> ''), "
    f"ec AS (SELECT {KEY}, length(seq) AS m, unnest(string_split(seq,'')) AS c, unnest(range(1,length(seq)+1)) AS pos FROM en)"
)


def triad_sql(block: str, gaps: Sequence[int], tail: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {KEY}, {g} AS gap, {digits('c', L.SEVEN_GROUPS.values())} || {digits(f'c{g + 1}', L.SEVEN_GROUPS.values())} || "
        f"{digits(f'c{2 * g + 2}', L.SEVEN_GROUPS.values())} AS token, count(*) AS k FROM w WHERE c{2 * g + 2} IS NOT NULL GROUP BY ALL"
        for g in gaps
    )
    return (
        f"SELECT t.\"ID\", t.\"Dataset\", '{block}', '{block}_g' || token[1] || '.g' || token[2] || '.g' || token[3]{tail}, (k-lo)/CAST(hi AS DOUBLE) "
        f"FROM ({parts}) t JOIN (SELECT {KEY}, gap, max(k) AS hi, CASE WHEN count(*)=343 THEN min(k) ELSE 0 END AS lo FROM ({parts}) GROUP BY ALL) u "
        "ON u.\"ID\"=t.\"ID\" AND u.\"Dataset\"=t.\"Dataset\" AND u.gap=t.gap"
    )


def window_sql(block: str, width: int, token: str, extra: str = "") -> str:
    return (
        f"SELECT {KEY}, '{block}', '{block}_SW.' || o || '.' || {token}, count(*)/{width}.0::DOUBLE FROM ec {extra} "
        f"JOIN (SELECT unnest(range(1,{8 - width})) AS o) ON pos>=o AND pos<o+{width} WHERE m>=o+{width - 1} GROUP BY {KEY}, o, {token}"
    )


def place_sql(block: str, table: str) -> str:
    return f"SELECT {KEY}, '{block}', '{block}_p' || pos || '.' || prop, v FROM ec JOIN {table} ON letter=c"


ASDC = (
    f"SELECT {KEY}, 'ASDC', 'ASDC_' || c || u.b, sum(u.t)/(max(n)*(max(n)-1)/2.0::DOUBLE) FROM (SELECT {KEY}, n, c, unnest(["
    + ", ".join(f"{{'b':'{a}','t':after_{a}}}" for a in L.LETTERS)
    + f"]) AS u FROM (SELECT {KEY}, n, c, "
    + ", ".join(f"sum(after_{a}) AS after_{a}" for a in L.LETTERS)
    + f" FROM (SELECT {KEY}, n, c, "
    + ", ".join(
        f"sum(CASE WHEN c='{a}' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY pos DESC) - CASE WHEN c='{a}' THEN 1 ELSE 0 END AS after_{a}"
        for a in L.LETTERS
    )
    + f" FROM bc) GROUP BY {KEY}, n, c)) WHERE u.t > 0 GROUP BY {KEY}, c, u.b"
)
FIVE_PAIRS = "FROM p JOIN five x ON x.letter=p.a JOIN five y ON y.letter=p.b"
CHARGE = " + ".join(
    [f"{n}/(1+pow(10.0::DOUBLE,7.4::DOUBLE-{pk}))" for n, pk in (("1" if k == "n_end" else f"coalesce(sum(k) FILTER (WHERE a='{k}'),0)", v) for k, v in L.PK_POSITIVE.items())]
) + " - " + " - ".join(
    [f"{n}/(1+pow(10.0::DOUBLE,{pk}-7.4::DOUBLE))" for n, pk in (("1" if k == "c_end" else f"coalesce(sum(k) FILTER (WHERE a='{k}'),0)", v) for k, v in L.PK_NEGATIVE.items())]
)
PHYSICAL = {
    "Length": "max(n)", "Aromaticity": "coalesce(sum(k) FILTER (WHERE a IN ('F','W','Y')),0)/CAST(max(n) AS DOUBLE)",
    "Hydrophobicity": "sum(k*h)/max(n)", "NetC": CHARGE, "MW": f"sum(k*w)+{L.WATER_MASS}",
}
PHYSICAL_VALUES = values([(a, L.hydropathy()[a], L.residue_masses()[a]) for a in L.LETTERS], "letter, h, w", "ph")
SQL: dict[str, str] = {
    "AAC": f"SELECT {KEY}, 'AAC', 'AAC_' || a, k/CAST(n AS DOUBLE) FROM l",
    "CKSAAP": f"SELECT {KEY}, 'CKSAAP', 'CKSAAP_' || a || b || '.gap' || (lag-1), k/CAST(n-lag AS DOUBLE) FROM p WHERE lag <= 5",
    "TPC": f"SELECT {KEY}, 'TPC', 'TPC_' || c || c1 || c2, count(*)/CAST(max(n)-2 AS DOUBLE) FROM w WHERE c2 IS NOT NULL GROUP BY {KEY}, c, c1, c2",
    "DPC": f"SELECT {KEY}, 'DPC', 'DPC_' || a || b, k/CAST(n-1 AS DOUBLE) FROM p WHERE lag=1",
    "DDE": "SELECT s.\"ID\", s.\"Dataset\", 'DDE', 'DDE_' || x.a || y.a, (coalesce(p.k,0)/CAST(s.n-1 AS DOUBLE)-(x.k/61.0::DOUBLE)*(y.k/61.0::DOUBLE))"
           "/sqrt((x.k/61.0::DOUBLE)*(y.k/61.0::DOUBLE)*(1-(x.k/61.0::DOUBLE)*(y.k/61.0::DOUBLE))/(s.n-1)) "
           "FROM (SELECT \"ID\", \"Dataset\", length(\"Sequence\") AS n FROM comb WHERE length(\"Sequence\")>1) s CROSS JOIN codons x CROSS JOIN codons y "
           "LEFT JOIN p ON p.\"ID\"=s.\"ID\" AND p.\"Dataset\"=s.\"Dataset\" AND p.lag=1 AND p.a=x.a AND p.b=y.a",
    "GAAC": f"SELECT {KEY}, 'GAAC', 'GAAC_' || g, sum(k)/CAST(max(n) AS DOUBLE) FROM l JOIN five ON letter=a GROUP BY {KEY}, g",
    "CKSAAGP": f"SELECT {KEY}, 'CKSAAGP', 'CKSAAGP_' || x.g || '.' || y.g || '.gap' || (lag-1), sum(k)/CAST(max(n-lag) AS DOUBLE) {FIVE_PAIRS} GROUP BY {KEY}, lag, x.g, y.g",
    "GDPC": f"SELECT {KEY}, 'GDPC', 'GDPC_' || x.g || '.' || y.g, sum(k)/CAST(max(n-1) AS DOUBLE) {FIVE_PAIRS} WHERE lag=1 GROUP BY {KEY}, x.g, y.g",
    "GTPC": f"SELECT {KEY}, 'GTPC', 'GTPC_' || x.g || '.' || y.g || '.' || z.g, sum(k)/CAST(max(n-2) AS DOUBLE) FROM "
            f"(SELECT {KEY}, n, c, c1, c2, count(*) AS k FROM w WHERE c2 IS NOT NULL GROUP BY ALL) JOIN five x ON x.letter=c JOIN five y ON y.letter=c1 JOIN five z ON z.letter=c2 GROUP BY {KEY}, x.g, y.g, z.g",
    "Moran": f"SELECT {KEY}, 'Moran', 'Moran_' || pa || '.lag' || lag, t/(spread/n) FROM co JOIN st USING ({KEY}) WHERE pa=pb AND st.prop=pa AND spread > 1e-9 AND lag <= 4",
    "Geary": f"SELECT {KEY}, 'Geary', 'Geary_' || x.prop || '.lag' || lag, (max(p.n)-1)/(2.0::DOUBLE*max(p.n-lag))*sum(k*(x.v-y.v)*(x.v-y.v))/max(spread) "
             f"FROM p JOIN props x ON x.letter=p.a JOIN props y ON y.letter=p.b AND y.prop=x.prop JOIN st USING ({KEY}) WHERE st.prop=x.prop AND p.n > 4 AND spread > 1e-9 AND lag <= 4 GROUP BY {KEY}, x.prop, lag",
    "NMBroto": f"SELECT {KEY}, 'NMBroto', 'NMBroto_' || x.prop || '.lag' || lag, sum(k*x.v*y.v)/max(n-lag) FROM p JOIN props x ON x.letter=p.a JOIN props y ON y.letter=p.b AND y.prop=x.prop WHERE lag <= 5 GROUP BY {KEY}, x.prop, lag",
    "CTDC": f"SELECT {KEY}, 'CTDC', 'CTDC_' || c || '.G' || i, sum(k)/CAST(max(n) AS DOUBLE) FROM l JOIN cls ON letter=a GROUP BY {KEY}, c, i",
    "CTDT": f"SELECT {KEY}, 'CTDT', 'CTDT_' || x.c || '.Tr' || least(x.i,y.i) || greatest(x.i,y.i) || greatest(x.i,y.i) || least(x.i,y.i), sum(k)/CAST(max(n-1) AS DOUBLE) "
            f"FROM p JOIN cls x ON x.letter=p.a JOIN cls y ON y.letter=p.b AND y.c=x.c WHERE lag=1 AND x.i<>y.i GROUP BY {KEY}, x.c, least(x.i,y.i), greatest(x.i,y.i)",
    "CTDD": f"SELECT {KEY}, 'CTDD', 'CTDD_' || cl || '.' || i || '.' || u.r, u.v FROM (SELECT {KEY}, cl, i, unnest(["
            + ", ".join(f"{{'r':'residue{int(100 * s)}','v':max(CASE WHEN r=greatest(1,CAST(floor({s}::DOUBLE*m) AS BIGINT)) THEN pos*100.0::DOUBLE/n END)}}" for s in (0.0, 0.25, 0.5, 0.75, 1.0))
            + f"]) AS u FROM (SELECT {KEY}, n, pos, cls.c AS cl, i, row_number() OVER (PARTITION BY {KEY}, cls.c, i ORDER BY pos) AS r, count(*) OVER (PARTITION BY {KEY}, cls.c, i) AS m "
            f"FROM bc JOIN cls ON letter=bc.c) GROUP BY {KEY}, cl, i)",
    "CTriad": triad_sql("CTriad", [0], ""),
    "KSCTriad": triad_sql("KSCTriad", [0, 1], " || '.gap' || t.gap"),
    "SOCNumber": f"SELECT {KEY}, 'SOCNumber', 'SOCNumber_gGrantham.lag' || lag, total/(n-lag) FROM cp",
    "QSOrder": f"SELECT {KEY}, 'QSOrder', 'QSOrder_Grantham.Xr.' || a, k/coalesce(base,1.0::DOUBLE) FROM l LEFT JOIN qo USING ({KEY}) "
               f"UNION ALL SELECT {KEY}, 'QSOrder', 'QSOrder_Grantham.Xd.' || lag, 0.05::DOUBLE*total/base FROM cp JOIN qo USING ({KEY}) WHERE lag <= 3",
    "PAAC": f"SELECT {KEY}, 'PAAC', 'PAAC_Xc1.' || a, k/(1+t) FROM l JOIN pa USING ({KEY}) UNION ALL SELECT {KEY}, 'PAAC', 'PAAC_Xc2.lambda1', t/(1+t) FROM pa",
    "APAAC": f"SELECT {KEY}, 'APAAC', 'APAAC_Pc1.' || a, k/base FROM l JOIN ap USING ({KEY}) UNION ALL SELECT {KEY}, 'APAAC', 'APAAC_Pc2.' || prop || '.1', 0.05::DOUBLE*t/base "
             f"FROM th JOIN ap USING ({KEY}) WHERE prop IN ('{list(STD)[0]}','{list(STD)[1]}')",
    "ASDC": ASDC,
    "AC": f"SELECT {KEY}, 'AC', 'AC_' || pa || '.lag' || lag, t FROM co WHERE pa=pb AND lag <= 3",
    "CC": f"SELECT {KEY}, 'CC', 'CC_' || pa || '.' || pb || '.lag' || lag, t FROM co WHERE pa<>pb AND lag <= 3",
    "ACC": f"SELECT {KEY}, 'ACC', 'ACC_' || pa || '.' || pb || '.lag' || lag, t FROM co WHERE lag <= 3",
    "EAAC": window_sql("EAAC", 4, "c"),
    "EGAAC": window_sql("EGAAC", 3, "g", "JOIN five ON letter=c"),
    "AAIndex": place_sql("AAIndex", "raw"),
    "BLOSUM62": place_sql("BLOSUM62", "mat"),
    "ZScale": place_sql("ZScale", "zs"),
    "Physicochemical": f"SELECT {KEY}, 'Physicochemical', u.f, u.v FROM (SELECT {KEY}, unnest([{', '.join(f'''{{'f':'{f}','v':CAST({e} AS DOUBLE)}}''' for f, e in PHYSICAL.items())}]) AS u "
                       f"FROM l JOIN (WITH {PHYSICAL_VALUES} SELECT * FROM ph) ph ON letter=a GROUP BY {KEY})",
}


def blocks_sql(names: Sequence[str] = B.NAMES) -> str:
    """CTE ``blocks``: (ID, Dataset, block, feature, value)."""
    each = " UNION ALL ".join(f"SELECT * FROM ({SQL[n]}) t({KEY}, block, feature, value)" for n in names)
    return f"{BASE}, blocks AS (SELECT * FROM ({each}))"


#: A number for every feature name, so that sums depend on which feature has which value.
WEIGHT_SQL = "list_sum(list_transform(string_split(feature,''), lambda x, i: i*ascii(x)))%97"
WEIGHTED = f"wt AS (SELECT feature, CAST({WEIGHT_SQL} AS INTEGER) AS weight FROM (SELECT DISTINCT feature FROM blocks))"


def weight():
    codes = F.transform(F.split("feature", ""), lambda x, i: F.ascii(x) * (i + 1))
    return (F.aggregate(codes, F.lit(0), lambda a, b: a + b) % 97).cast("int")


def weights(spark, names, by: Sequence[str] = ()):
    """The names' numbers as one array, or one for each block: as many as there are features."""
    rows = B.dictionary(spark, names).select(*by, "at", weight().alias("weight"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda c: c["weight"]).alias("weights"))


def sequences(spark, folder):
    return spread_rows(combined(spark, folder).withColumn("seq", F.col("Sequence")), "ID")


def summed(places="places"):
    """Cells that differ from zero, their sum and their weighted sum."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    each = F.zip_with(places, "values", lambda at, v: F.get("weights", at) * v)
    return [
        F.size(F.filter("values", lambda v: F.abs(v) > 1e-9)).cast("long").alias("n_cells"),
        # a little more, so that what lies between two roundings goes up everywhere
        F.round(total(F.col("values")) + 1e-8, 4).alias("total"), F.round(total(each) + 1e-7, 3).alias("weighted"),
    ]


SUMMED = "count(*) FILTER (WHERE abs(value)>1e-9) AS n_cells, round(coalesce(sum(value),0)+1e-8,4) AS total, round(coalesce(sum(value*weight),0)+1e-7,3) AS weighted"


@query("all_blocks", f"WITH {blocks_sql()}, {WEIGHTED} SELECT {KEY}, block, {SUMMED} FROM blocks JOIN wt USING (feature) WHERE value <> 0 GROUP BY {KEY}, block")
def all_blocks(spark, folder):
    """Every block of every text, from one read."""
    cells = B.block_cells(sequences(spark, folder), KEYS)
    return cells.join(F.broadcast(weights(spark, B.NAMES, ["block"])), "block").select(*KEYS, "block", *summed())


JOINED = f"WITH {blocks_sql()}, {WEIGHTED} SELECT {KEY}, {SUMMED} FROM blocks JOIN wt USING (feature) GROUP BY {KEY}"


@query("join_blocks", JOINED)
def join_blocks(spark, folder):
    """All blocks of a text side by side."""
    joined = B.joined_cells(sequences(spark, folder), KEYS)
    return joined.crossJoin(F.broadcast(weights(spark, B.NAMES))).select(*KEYS, *summed())


def dense_sums(weights: Sequence[int]):
    """A function of full rows, as many numbers as there are weights: their sum and their weighted sum, in order; nulls are zero."""
    each = np.array(weights, float)

    @F.arrow_udf("total double, weighted double")
    def sums(values: pa.Array) -> pa.Array:
        m = np.asarray(pc.fill_null(values.flatten(), 0.0)).reshape(len(values), len(each))
        both = [np.zeros(len(m)), np.zeros(len(m))]
        for i, row in enumerate(m):  # one row at a time stays in the cache
            both[0][i], both[1][i] = np.cumsum(row)[-1], np.cumsum(row * each)[-1]
        return pa.StructArray.from_arrays([pa.array(x) for x in both], ["total", "weighted"])

    return sums


@query(
    "dense_vectors",
    f"WITH {blocks_sql()}, {WEIGHTED} SELECT {KEY}, {sum(len(b.features) for b in B.descriptors().values())} AS size, "
    f"{SUMMED.split(',', 1)[1]} FROM blocks JOIN wt USING (feature) GROUP BY {KEY}",
)
def dense_vectors(spark, folder):
    """The joined rows in full."""
    dense = B.dense_blocks(sequences(spark, folder), KEYS).withColumnRenamed("features", "values")
    rows = dense.withColumn("sums", dense_sums(weights(spark, B.NAMES).first()["weights"])("values"))
    # a little more, as in `summed`
    return rows.select(
        *KEYS, F.size("values").alias("size"),
        F.round(F.col("sums.total") + 1e-8, 4).alias("total"), F.round(F.col("sums.weighted") + 1e-7, 3).alias("weighted"),
    )


def store(spark, folder, names):
    path = scratch(spark)
    cells = B.block_cells(sequences(spark, folder), KEYS, names=names)
    return B.BlockStore.write(cells, path, f"blocks_{uuid.uuid4().hex}", KEYS, BUCKETS)


STORED = ("CKSAAP type 1", "TPC type 1", "DDE", "CTDD", "QSOrder", "ZScale")


@query(
    "write_read_block",
    f"WITH {blocks_sql(('TPC', 'AAC'))} SELECT {KEY}, block, feature, round(value,6) AS value FROM blocks WHERE block='AAC'",
)
def write_read_block(spark, folder):
    kept = store(spark, folder, ("TPC type 1", "AAC type 1"))
    cells = B.long_cells(kept.block("AAC type 1"), KEYS, B.dictionary(spark, ["AAC"]))
    return cells.select(*KEYS, "block", "feature", r6("value"))


@query(
    "join_stored_blocks",
    f"WITH {blocks_sql([n.split(' ')[0] for n in STORED])}, {WEIGHTED}, g AS (SELECT {KEY}, count(DISTINCT block) AS n, {SUMMED} "
    f"FROM blocks JOIN wt USING (feature) WHERE value <> 0 GROUP BY {KEY}) SELECT {KEY}, n_cells, total, weighted FROM g WHERE n={len(STORED)}",
)
def join_stored_blocks(spark, folder):
    """Blocks of the store that belong together, joined bucket by bucket."""
    joined = store(spark, folder, STORED).joined(STORED)
    return joined.crossJoin(F.broadcast(weights(spark, STORED))).select(*KEYS, *summed())


# ---- names ------------------------------------------------------------------

def named(spark, folder, names=B.NAMES):
    """(block, feature) of every cell that is there."""
    cells = B.block_cells(sequences(spark, folder), KEYS, names=names)
    places = cells.select("block", F.explode("places").alias("place")).distinct()
    return places.join(F.broadcast(B.dictionary(spark, names)), ["block", "place"])


NAMED = f"WITH {blocks_sql()}, named AS (SELECT DISTINCT block, feature FROM blocks WHERE abs(value) > 0)"


@query("feature_dictionary", f"{NAMED} SELECT block, feature FROM named")
def feature_dictionary(spark, folder):
    return T.feature_dictionary(named(spark, folder))


@query("sorted_names", f"{NAMED} SELECT DISTINCT feature FROM named")
def sorted_names(spark, folder):
    return T.sorted_names(T.feature_dictionary(named(spark, folder)))


@query("count_features", f"{NAMED} SELECT count(DISTINCT feature) AS n_features FROM named")
def count_features(spark, folder):
    return T.count_features(T.feature_dictionary(named(spark, folder)))


SOME_SQL = f"WITH {blocks_sql(SOME)}"


@query(
    "select_features",
    f"{SOME_SQL} SELECT \"ID\", feature, round(value,6) AS value FROM blocks WHERE block='DPC' AND feature LIKE '%E%'",
)
def select_features(spark, folder):
    names = B.dictionary(spark, SOME)
    rows = B.long_cells(B.block_cells(sequences(spark, folder), KEYS, names=SOME), KEYS, names)
    keep = names.filter("block = 'DPC' AND feature LIKE '%E%'")
    return T.select_features(rows, keep).select("ID", "feature", r6("value"))


@query("feature_difference", f"{SOME_SQL} SELECT DISTINCT feature FROM blocks WHERE value <> 0 AND feature NOT LIKE '%E%'")
def feature_difference(spark, folder):
    names = named(spark, folder, SOME).select("feature").distinct()
    return T.feature_difference(names, names.filter("feature LIKE '%E%'"))
