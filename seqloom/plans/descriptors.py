"""Descriptor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.operators import composition as C
from seqloom.operators import lags as G
from seqloom.operators import selected as X
from seqloom.plans.base import (
    ITEMS, SEQS, TURNS, chars, distance_sql, items, labeled, props_sql, query, r6, seqs, turns,
    values,
)

DOC = ["doc_id"]
TURN = ["conv_id", "turn"]
SEQ_CH = f"WITH {SEQS}, {chars('seqs', 'doc_id')}"
TURN_CH = f"WITH {TURNS}, {chars('turns', 'conv_id, turn')}"
FIVE = list(L.FIVE_GROUPS.values())
SEVEN = list(L.SEVEN_GROUPS.values())


def recode_sql(expr: str, classes) -> str:
    source = "".join(classes)
    target = "".join(str(i) * len(m) for i, m in enumerate(classes, 1))
    return f"translate({expr},'{source}','{target}')"


def kmer_sql(k: int, classes=None) -> str:
    """Windowed neighbours instead of array indexing."""
    c = "c" if classes is None else recode_sql("c", classes)
    tail = "".join(f" || lead(x,{j}) OVER w" for j in range(1, k))
    return (
        f"{SEQ_CH}, x AS (SELECT doc_id, n, pos, {c} AS x FROM ch), "
        f"t AS (SELECT doc_id, n, x{tail} AS token FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) "
        f"SELECT doc_id, token, round(count(*)/CAST(max(n)-{k - 1} AS DOUBLE),6) AS value "
        "FROM t WHERE token IS NOT NULL GROUP BY doc_id, token"
    )


def register_kmers(name: str, k: int, groups=None):
    classes = None if groups is None else list(groups.values())

    @query(name, kmer_sql(k, classes))
    def run(spark, folder):
        df = seqs(spark, folder)
        out = C.kmer_frequency(df, DOC, k) if groups is None else C.group_kmer_frequency(df, DOC, k, groups)
        return out.select("doc_id", "token", r6("value"))


register_kmers("aac", 1)
register_kmers("dpc", 2)
register_kmers("tpc", 3)
register_kmers("gaac", 1, L.FIVE_GROUPS)
register_kmers("gdpc", 2, L.FIVE_GROUPS)
register_kmers("gtpc", 3, L.FIVE_GROUPS)


def gapped_sql(kspace: int, classes=None) -> str:
    c = "c" if classes is None else recode_sql("c", classes)
    lead = ", ".join(f"lead(x,{g + 1}) OVER o AS x{g}" for g in range(kspace + 1))
    cells = ", ".join(f"{{'gap':{g},'other':x{g}}}" for g in range(kspace + 1))
    return (
        f"{TURN_CH}, x AS (SELECT conv_id, turn, n, pos, {c} AS x FROM ch), "
        f"w AS (SELECT conv_id, turn, n, x, {lead} FROM x WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)), "
        f"un AS (SELECT conv_id, turn, n, x, unnest([{cells}]) AS u FROM w) "
        "SELECT conv_id, turn, CAST(u.gap AS INTEGER) AS gap, x || u.other AS token, "
        "round(count(*)/CAST(max(n)-max(u.gap)-1 AS DOUBLE),6) AS value "
        "FROM un WHERE u.other IS NOT NULL GROUP BY 1,2,3,4"
    )


@query("cksaap", gapped_sql(4))
def cksaap(spark, folder):
    out = C.gapped_pair_frequency(turns(spark, folder), TURN, 4)
    return out.select(*TURN, "gap", "token", r6("value"))


@query("cksaagp", gapped_sql(10, FIVE))
def cksaagp(spark, folder):
    out = C.group_gapped_pair_frequency(turns(spark, folder), TURN, 10, L.FIVE_GROUPS)
    return out.select(*TURN, "gap", "token", r6("value"))


CODON_SQL = values([(a, int(n)) for a, n in L.CODONS.items()], "a, k", "codons")


@query(
    "dde",
    f"{SEQ_CH}, {CODON_SQL}, pairs AS (SELECT doc_id, c || lead(c) OVER (PARTITION BY doc_id ORDER BY pos) AS token FROM ch), "
    "cnt AS (SELECT doc_id, token, count(*) AS k FROM pairs WHERE token IS NOT NULL GROUP BY 1,2), "
    "tm AS (SELECT x.a || y.a AS token, (x.k/61.0::DOUBLE)*(y.k/61.0::DOUBLE) AS tm FROM codons x CROSS JOIN codons y) "
    "SELECT s.doc_id, tm.token, round((coalesce(cnt.k,0)/CAST(length(s.seq)-1 AS DOUBLE)-tm.tm)"
    "/sqrt(tm.tm*(1-tm.tm)/(length(s.seq)-1)),6) AS value "
    "FROM seqs s CROSS JOIN tm LEFT JOIN cnt ON cnt.doc_id=s.doc_id AND cnt.token=tm.token",
)
def dde(spark, folder):
    return C.pair_deviation(seqs(spark, folder), DOC).select("doc_id", "token", r6("value"))


# ---- lag family: the SQL pairs positions by self-join, Spark counts pairs first

RAW = L.property_rows()
STD = L.standardized_rows()


def lag_sql(rows, nlag: int, value: str, cross: bool = False, tail: str | None = None) -> str:
    """``value`` is one cell: P and Q stand for the two letters' values, MP and MQ for their means,
    VP for the population variance, N for the length.  Cells are unnested into rows."""
    names = list(rows)
    wide = values([(a, *[float(rows[p][a]) for p in names]) for a in L.LETTERS],
                  "letter, " + ", ".join(f"p{i}" for i in range(len(names))), "lv")
    idx, lags = range(len(names)), range(1, nlag + 1)
    lead = ", ".join(f"lead(p{i},{d}) OVER o AS p{i}_{d}" for i in idx for d in lags)
    stat = ", ".join(f"avg(p{i}) AS m{i}, var_pop(p{i}) AS v{i}" for i in idx)
    cells = [(i, j, d) for i in idx for j in (idx if cross else [i]) for d in lags]

    def cell(i, j, d):
        out = value
        for mark, text in (("{P}", f"p{i}"), ("{Q}", f"p{j}_{d}"), ("{MP}", f"m{i}"), ("{MQ}", f"m{j}"),
                           ("{VP}", f"max(v{i})"), ("{N}", "max(w.n)"), ("{LAG}", str(d))):
            out = out.replace(mark, text)
        return out

    agg = ", ".join(f"{cell(*x)} AS x{k}" for k, x in enumerate(cells))
    lst = ", ".join(f"{{'prop':'{names[i]}','prop2':'{names[j]}','lag':{d},'value':x{k}}}" for k, (i, j, d) in enumerate(cells))
    return (
        f"{SEQ_CH}, {wide}, w AS (SELECT doc_id, n, pos, {', '.join(f'p{i}' for i in idx)}, {lead} FROM ch JOIN lv ON letter=c "
        f"WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), st AS (SELECT doc_id, {stat} FROM w GROUP BY doc_id), "
        f"ag AS (SELECT w.doc_id, {agg} FROM w JOIN st USING (doc_id) GROUP BY w.doc_id), "
        f"un AS (SELECT doc_id, unnest([{lst}]) AS u FROM ag), "
        "th AS (SELECT doc_id, u.prop AS prop, u.prop2 AS prop2, CAST(u.lag AS INTEGER) AS lag, u.value AS t FROM un WHERE u.value IS NOT NULL OR u.lag < 0) "
        + (tail if tail is not None else "SELECT doc_id, prop, lag, round(t,6) AS value FROM th")
    )


MORAN = "CASE WHEN {VP}*{N} > 1e-9 THEN avg(({P}-{MP})*({Q}-{MQ}))/{VP} END"
GEARY = "CASE WHEN {N} > 4 AND {VP}*{N} > 1e-9 THEN ({N}-1)/(2.0::DOUBLE*({N}-{LAG}))*sum(({P}-{Q})*({P}-{Q}))/({VP}*{N}) END"
COVARIANCE = "avg(({P}-{MP})*({Q}-{MQ}))"
WITH_PAIR = "SELECT doc_id, prop, prop2, lag, round(t,6) AS value FROM th"


@query("moran", lag_sql(STD, 4, MORAN))
def moran(spark, folder):
    return G.moran(seqs(spark, folder), DOC, STD, 4).filter("value IS NOT NULL").select("doc_id", "prop", "lag", r6("value"))


@query("geary", lag_sql(STD, 4, GEARY))
def geary(spark, folder):
    return G.geary(seqs(spark, folder), DOC, STD, 4).filter("value IS NOT NULL").select("doc_id", "prop", "lag", r6("value"))


@query("nmbroto", lag_sql(STD, 5, "avg({P}*{Q})"))
def nmbroto(spark, folder):
    return G.normalized_moreau_broto(seqs(spark, folder), DOC, STD, 5).select("doc_id", "prop", "lag", r6("value"))


@query("ac", lag_sql(STD, 3, COVARIANCE, tail=WITH_PAIR))
def ac(spark, folder):
    return G.auto_covariance(seqs(spark, folder), DOC, STD, 3).select("doc_id", "prop", "prop2", "lag", r6("value"))


@query("cc", lag_sql(STD, 3, COVARIANCE, cross=True, tail=WITH_PAIR + " WHERE prop <> prop2"))
def cc(spark, folder):
    return G.cross_covariance(seqs(spark, folder), DOC, STD, 3).select("doc_id", "prop", "prop2", "lag", r6("value"))


@query("acc", lag_sql(STD, 3, COVARIANCE, cross=True, tail=WITH_PAIR))
def acc(spark, folder):
    return G.auto_cross_covariance(seqs(spark, folder), DOC, STD, 3).select(
        "doc_id", "prop", "prop2", "lag", r6("value")
    )


def coupling_sql(nlag: int) -> str:
    lags = range(1, nlag + 1)
    lead = ", ".join(f"lead(c,{d}) OVER o AS c{d}" for d in lags)
    cells = ", ".join(f"{{'lag':{d},'other':c{d}}}" for d in lags)
    return (
        f"{SEQ_CH}, {distance_sql()}, w AS (SELECT doc_id, c, {lead} FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), "
        f"un AS (SELECT doc_id, c, unnest([{cells}]) AS u FROM w), "
        "cp AS (SELECT doc_id, CAST(u.lag AS INTEGER) AS lag, sum(d*d) AS total, avg(d*d) AS mean FROM un "
        "JOIN dist ON a=c AND b=u.other GROUP BY 1, 2)"
    )


@query("socnumber", coupling_sql(5) + " SELECT doc_id, lag, round(mean,6) AS value FROM cp")
def socnumber(spark, folder):
    return G.order_coupling(seqs(spark, folder), DOC, L.grantham(), 5).select("doc_id", "lag", r6("value"))


@query(
    "qsorder",
    coupling_sql(3)
    + ", base AS (SELECT doc_id, 1+0.05::DOUBLE*sum(total) AS b FROM cp GROUP BY doc_id) "
    "SELECT ch.doc_id, 'Xr.' || c AS feature, round(count(*)/max(b),9) AS value FROM ch JOIN base USING (doc_id) "
    "GROUP BY ch.doc_id, c UNION ALL SELECT doc_id, 'Xd.' || lag, round(0.05::DOUBLE*total/b,9) FROM cp JOIN base USING (doc_id)",
)
def qsorder(spark, folder):
    out = G.quasi_sequence_order(seqs(spark, folder), DOC, L.grantham())
    return out.select("doc_id", "feature", F.round("value", 9).alias("value"))


@query(
    "paac",
    lag_sql(
        STD, 1, "avg(({P}-{Q})*({P}-{Q}))",
        tail=", base AS (SELECT doc_id, avg(t) AS t FROM th GROUP BY doc_id) "
        "SELECT doc_id, 'Xc1.' || c AS feature, round(count(*)/(1+0.05::DOUBLE*max(t)),6) AS value FROM ch JOIN base USING (doc_id) "
        "GROUP BY doc_id, c UNION ALL SELECT doc_id, 'Xc2.lambda1', round(0.05::DOUBLE*t/(1+0.05::DOUBLE*t),6) FROM base",
    ),
)
def paac(spark, folder):
    return G.pseudo_composition(seqs(spark, folder), DOC, RAW).select("doc_id", "feature", r6("value"))


TWO = {p: RAW[p] for p in list(RAW)[:2]}


@query(
    "apaac",
    lag_sql(
        {p: STD[p] for p in TWO}, 1, "avg({P}*{Q})",
        tail=", base AS (SELECT doc_id, 1+0.05::DOUBLE*sum(t) AS b FROM th GROUP BY doc_id) "
        "SELECT doc_id, 'Pc1.' || c AS feature, round(count(*)/max(b),6) AS value FROM ch JOIN base USING (doc_id) "
        "GROUP BY doc_id, c UNION ALL SELECT th.doc_id, 'Pc2.' || prop || '.1', round(0.05::DOUBLE*t/b,6) "
        "FROM th JOIN base USING (doc_id)",
    ),
)
def apaac(spark, folder):
    return G.amphiphilic_pseudo_composition(seqs(spark, folder), DOC, TWO).select("doc_id", "feature", r6("value"))


# ---- classes ----------------------------------------------------------------

CHARGE = L.THREE_CLASSES["charge"]
SOLVENT = L.THREE_CLASSES["solventaccess"]
VOLUME = L.THREE_CLASSES["normwaalsvolume"]


@query(
    "ctdc",
    f"{SEQ_CH} SELECT doc_id, round(sum(CASE WHEN c IN ('K','R') THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE),6) AS charge_g1, "
    "round(1-sum(CASE WHEN contains('ALFCGIVW',c) THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE)"
    "-sum(CASE WHEN contains('RKQEND',c) THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE),6) AS solvent_g3 FROM ch GROUP BY doc_id",
)
def ctdc(spark, folder):
    return seqs(spark, folder).select(
        "doc_id",
        r6(S.class_fraction("seq", CHARGE[0]), "charge_g1"),
        r6(S.rest_fraction("seq", SOLVENT[0], SOLVENT[1]), "solvent_g3"),
    )


@query(
    "ctdt",
    f"{SEQ_CH}, k AS (SELECT doc_id, n, pos, CASE WHEN contains('{SOLVENT[0]}',c) THEN 1 WHEN contains('{SOLVENT[1]}',c) "
    "THEN 2 ELSE 3 END AS k FROM ch), p AS (SELECT doc_id, n, k, lead(k) OVER (PARTITION BY doc_id ORDER BY pos) AS k2 FROM k), "
    "t AS (SELECT doc_id, max(n)-1 AS m, sum(CASE WHEN least(k,k2)=1 AND greatest(k,k2)=2 THEN 1 ELSE 0 END) AS a, "
    "sum(CASE WHEN least(k,k2)=1 AND greatest(k,k2)=3 THEN 1 ELSE 0 END) AS b, "
    "sum(CASE WHEN least(k,k2)=2 AND greatest(k,k2)=3 THEN 1 ELSE 0 END) AS c FROM p WHERE k2 IS NOT NULL GROUP BY doc_id) "
    "SELECT doc_id, '12' AS token, round(a/CAST(m AS DOUBLE),6) AS value FROM t "
    "UNION ALL SELECT doc_id, '13', round(b/CAST(m AS DOUBLE),6) FROM t "
    "UNION ALL SELECT doc_id, '23', round(c/CAST(m AS DOUBLE),6) FROM t",
)
def ctdt(spark, folder):
    return C.class_transitions(seqs(spark, folder), DOC, SOLVENT).select("doc_id", "token", r6("value"))


SHARES = {"p1": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


@query(
    "ctdd",
    f"{SEQ_CH}, hit AS (SELECT doc_id, n, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, "
    f"count(*) OVER (PARTITION BY doc_id) AS m FROM ch WHERE contains('{VOLUME[1]}', c)), "
    "q AS (SELECT doc_id, "
    + ", ".join(
        f"max(CASE WHEN r = greatest(1, CAST(floor({share}::DOUBLE*m) AS BIGINT)) THEN pos*100.0::DOUBLE/n END) AS {name}"
        for name, share in SHARES.items()
    )
    + " FROM hit GROUP BY doc_id) SELECT s.doc_id, "
    + ", ".join(f"round(coalesce(q.{name},0.0),6) AS {name}" for name in SHARES)
    + " FROM seqs s LEFT JOIN q USING (doc_id)",
)
def ctdd(spark, folder):
    return seqs(spark, folder).select(
        "doc_id", *[r6(S.class_quantile_position("seq", VOLUME[1], share), name) for name, share in SHARES.items()]
    )


def triad_sql(gaps) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, CAST({g} AS INTEGER) AS gap, x || lead(x,{g + 1}) OVER o || lead(x,{2 * g + 2}) OVER o AS token "
        "FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"
        for g in gaps
    )
    return (
        f"{SEQ_CH}, x AS (SELECT doc_id, pos, {recode_sql('c', SEVEN)} AS x FROM ch), "
        f"t AS (SELECT doc_id, gap, token, count(*) AS n FROM ({parts}) WHERE token IS NOT NULL GROUP BY 1,2,3), "
        "m AS (SELECT doc_id, gap, max(n) AS hi, CASE WHEN count(*)=343 THEN min(n) ELSE 0 END AS lo "
        "FROM t GROUP BY 1,2) SELECT t.doc_id, t.gap, token, round((n-lo)/CAST(hi AS DOUBLE),6) AS value "
        "FROM t JOIN m ON m.doc_id=t.doc_id AND m.gap=t.gap"
    )


@query("ctriad", triad_sql([0]))
def ctriad(spark, folder):
    return C.scaled_triples(seqs(spark, folder), DOC, L.SEVEN_GROUPS).select("doc_id", "gap", "token", r6("value"))


@query("ksctriad", triad_sql([0, 1]))
def ksctriad(spark, folder):
    out = C.scaled_triples(seqs(spark, folder), DOC, L.SEVEN_GROUPS, (0, 1))
    return out.select("doc_id", "gap", "token", r6("value"))


@query(
    "asdc",
    f"{SEQ_CH}, r AS (SELECT doc_id, n, pos, c, "
    + ", ".join(
        f"sum(CASE WHEN c='{a}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos DESC) "
        f"- CASE WHEN c='{a}' THEN 1 ELSE 0 END AS after_{a}"
        for a in L.LETTERS
    )
    + " FROM ch), s AS (SELECT doc_id, c, max(n) AS n, "
    + ", ".join(f"sum(after_{a}) AS t_{a}" for a in L.LETTERS)
    + " FROM r GROUP BY doc_id, c), u AS (SELECT doc_id, c, n, unnest(["
    + ", ".join(f"{{'b':'{a}','t':t_{a}}}" for a in L.LETTERS)
    + "]) AS u FROM s) SELECT doc_id, c || u.b AS token, round(u.t/(n*(n-1)/2.0::DOUBLE),6) AS value FROM u WHERE u.t > 0",
)
def asdc(spark, folder):
    return C.ordered_pairs(seqs(spark, folder), DOC).select("doc_id", "token", r6("value"))


# ---- per position -----------------------------------------------------------

def window_sql(width: int, classes=None) -> str:
    c = "c" if classes is None else recode_sql("c", classes)
    return (
        f"{TURN_CH}, x AS (SELECT conv_id, turn, n, pos, {c} AS x FROM ch) "
        f"SELECT x.conv_id, x.turn, CAST(x.pos-o.o AS INTEGER) AS \"window\", x AS token, round(count(*)/{width}.0::DOUBLE,6) AS value "
        f"FROM x CROSS JOIN (SELECT unnest(range(0,{width})) AS o) o WHERE x.pos-o.o >= 1 AND x.pos-o.o <= x.n-{width - 1} "
        "GROUP BY 1,2,3,4"
    )


@query("eaac", window_sql(4))
def eaac(spark, folder):
    return C.window_composition(turns(spark, folder), TURN, 4).select(*TURN, "window", "token", r6("value"))


@query("egaac", window_sql(3, FIVE))
def egaac(spark, folder):
    out = C.window_composition(turns(spark, folder), TURN, 3, L.recode(F.col("seq"), FIVE))
    return out.select(*TURN, "window", "token", r6("value"))


@query(
    "aaindex",
    f"{TURN_CH}, {props_sql(RAW)} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, prop, v AS value FROM ch JOIN props ON letter=c",
)
def aaindex(spark, folder):
    return C.positional_values(turns(spark, folder), TURN, L.letter_table(spark, RAW))


SIM_ROWS = {b: {a: L.similarity_scores()[a, b] for a in L.LETTERS} for b in L.LETTERS}


@query(
    "matrix_row",
    f"WITH {ITEMS}, {chars('items', 'item_id')}, {props_sql(SIM_ROWS)} "
    "SELECT item_id, CAST(pos AS INTEGER) AS pos, prop, v AS value FROM ch JOIN props ON letter=c",
)
def matrix_row(spark, folder):
    return C.positional_values(items(spark, folder), ["item_id"], L.letter_table(spark, SIM_ROWS))


Z_ROWS = {f"z{i + 1}": {a: z[i] for a, z in L.ZSCALES.items()} for i in range(5)}


@query(
    "zscale",
    f"WITH {SEQS}, ends AS (SELECT doc_id, left(seq,1) || right(seq,5) AS seq FROM seqs), {chars('ends', 'doc_id')}, "
    f"{props_sql(Z_ROWS)} SELECT doc_id, CAST(pos AS INTEGER) AS pos, prop, v AS value FROM ch JOIN props ON letter=c",
)
def zscale(spark, folder):
    ends = seqs(spark, folder).select("doc_id", S.terminal_reduce("seq").alias("seq"))
    return C.positional_values(ends, DOC, L.letter_table(spark, Z_ROWS))


# ---- whole-string scalars ---------------------------------------------------

HYD = props_sql({"kd": L.hydropathy()}, "kd")
MASS = props_sql({"mass": L.residue_masses()}, "mass")


def charge_sql(ph: str) -> str:
    up = " + ".join(
        (f"1/(1+pow(10.0::DOUBLE,{ph}-{pk}))" if k == "n_end" else f"count_{k}/(1+pow(10.0::DOUBLE,{ph}-{pk}))")
        for k, pk in L.PK_POSITIVE.items()
    )
    down = " + ".join(
        (f"1/(1+pow(10.0::DOUBLE,{pk}-{ph}))" if k == "c_end" else f"count_{k}/(1+pow(10.0::DOUBLE,{pk}-{ph}))")
        for k, pk in L.PK_NEGATIVE.items()
    )
    return f"({up}) - ({down})"


CHARGED = "KRHDECY"
COUNTS_SQL = ", ".join(f"CAST(sum(CASE WHEN c='{k}' THEN 1 ELSE 0 END) AS DOUBLE) AS count_{k}" for k in CHARGED)


@query(
    "physicochemical",
    f"{SEQ_CH}, {HYD}, {MASS}, k AS (SELECT doc_id, max(n) AS n, avg(kd.v) AS h, sum(mass.v) AS m, "
    "sum(CASE WHEN c IN ('F','W','Y') THEN 1 ELSE 0 END) AS ar, "
    f"{COUNTS_SQL} FROM ch JOIN kd ON kd.letter=c JOIN mass ON mass.letter=c GROUP BY doc_id) "
    "SELECT doc_id, CAST(n AS INTEGER) AS \"Length\", round(ar/CAST(n AS DOUBLE),6) AS \"Aromaticity\", "
    "round(h,6) AS \"Hydrophobicity\", "
    f"round({charge_sql('7.4')},6) AS \"NetC\", round(m+{L.WATER_MASS},4) AS \"MW\" FROM k",
)
def physicochemical(spark, folder):
    s = "seq"
    return seqs(spark, folder).select(
        "doc_id",
        F.length(s).alias("Length"),
        r6(S.class_fraction(s, "FWY"), "Aromaticity"),
        r6(F.try_divide(S.letter_sum(s, L.hydropathy()), F.length(s)), "Hydrophobicity"),
        r6(S.net_charge(s, 7.4), "NetC"),
        F.round(S.letter_sum(s, L.residue_masses(), L.WATER_MASS), 4).alias("MW"),
    )


@query(
    "additive_property",
    f"{SEQ_CH}, {props_sql({'m': RAW['SideChainMass']})} SELECT doc_id, round(sum(v),6) AS value FROM ch JOIN props ON letter=c GROUP BY doc_id",
)
def additive_property(spark, folder):
    return seqs(spark, folder).select("doc_id", r6(S.letter_sum("seq", RAW["SideChainMass"]), "value"))


@query(
    "titration_zero",
    f"{SEQ_CH}, k AS (SELECT doc_id, {COUNTS_SQL} FROM ch GROUP BY doc_id), "
    "g AS (SELECT unnest(range(0,1401))/100.0::DOUBLE AS ph), "
    f"z AS (SELECT doc_id, ph, round(abs({charge_sql('ph')}),9) AS q FROM k CROSS JOIN g), "
    "r AS (SELECT doc_id, ph, q, row_number() OVER (PARTITION BY doc_id ORDER BY q, ph) AS r FROM z) "
    "SELECT doc_id, ph AS value FROM r WHERE r=1",
)
def titration_zero(spark, folder):
    from seqloom.operators.titration import charge_zero

    return charge_zero(seqs(spark, folder), DOC).select("doc_id", F.col("ph").alias("value"))


@query("terminal_reduce", f"WITH {SEQS} SELECT doc_id, left(seq,1) || right(seq,5) AS seq FROM seqs")
def terminal_reduce(spark, folder):
    return seqs(spark, folder).select("doc_id", S.terminal_reduce("seq").alias("seq"))


# ---- named features ---------------------------------------------------------

def pair_sql(name: str, first: str, second: str, gap: int) -> str:
    return (
        f"coalesce(sum(CASE WHEN contains('{first}',c) AND contains('{second}',c{gap + 1}) THEN 1 ELSE 0 END)"
        f"/CAST(nullif(greatest(max(n)-{gap + 1},0),0) AS DOUBLE),0) AS \"{name}\""
    )


def dde_sql(name: str, a: str, b: str) -> str:
    tm = (L.CODONS[a] / 61) * (L.CODONS[b] / 61)
    return (
        f"(sum(CASE WHEN c='{a}' AND c1='{b}' THEN 1 ELSE 0 END)/CAST(max(n)-1 AS DOUBLE)-{tm!r}::DOUBLE)"
        f"/sqrt({tm * (1 - tm)!r}::DOUBLE/(max(n)-1)) AS \"{name}\""
    )


def ordered_sql(name: str, a: str, b: str) -> str:
    return f"sum(CASE WHEN c='{b}' THEN before_{a} ELSE 0 END)/(max(n)*(max(n)-1)/2.0::DOUBLE) AS \"{name}\""


def place_sql(tag: str, members: str) -> str:
    return (
        f"{tag} AS (SELECT doc_id, pos*100.0::DOUBLE/n AS spot, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, "
        f"count(*) OVER (PARTITION BY doc_id) AS m FROM ch WHERE contains('{members}',c))"
    )


def place_pick(tag: str, share: float, name: str) -> str:
    return f"coalesce({tag}{str(share).replace('.', '')}.spot,0) AS \"{name}\""


def place_join(tag: str, share: float) -> str:
    return (
        f" LEFT JOIN (SELECT doc_id, max(spot) AS spot FROM {tag} WHERE r=greatest(1,CAST(floor({share}::DOUBLE*m) AS BIGINT)) "
        f"GROUP BY doc_id) {tag}{str(share).replace('.', '')} USING (doc_id)"
    )


FEATURE_VALUES = values(
    [
        (a, float(STD["Hydrophobicity"][a]), float(STD["Hydrophilicity"][a]), float(STD["SideChainMass"][a]), float(L.ZSCALES[a][4]))
        for a in L.LETTERS
    ],
    "letter, p1, p2, p3, z5",
    "lv",
)
FIRST = L.FIVE_GROUPS


def feature_base_sql(extra: str = "") -> str:
    return (
        f"{SEQ_CH}, {FEATURE_VALUES}, {distance_sql()}, "
        "w AS (SELECT doc_id, n, pos, c, p1, p2, p3, z5, "
        + ", ".join(f"lead(c,{j}) OVER o AS c{j}" for j in (1, 2, 3, 4, 5, 10))
        + ", lead(p1) OVER o AS q1, lead(p2) OVER o AS q2, lead(p3) OVER o AS q3, "
        + ", ".join(
            f"coalesce(sum(CASE WHEN c='{a}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN "
            f"UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before_{a}"
            for a in "ADV"
        )
        + " FROM ch JOIN lv ON letter=c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), "
        "e AS (SELECT w.*, "
        + ", ".join(f"x{j}.d*x{j}.d AS d{j}" for j in (1, 2, 3))
        + " FROM w "
        + " ".join(f"LEFT JOIN dist x{j} ON x{j}.a=c AND x{j}.b=c{j}" for j in (1, 2, 3))
        + ")"
        + extra
    )


def triad_feature_sql() -> str:
    return (
        ", tri AS (SELECT doc_id, " + " || ".join(recode_sql(c, SEVEN) for c in ("c", "c2", "c4")) + " AS token, count(*) AS k "
        "FROM w WHERE c4 IS NOT NULL GROUP BY 1,2), trm AS (SELECT doc_id, (coalesce(max(CASE WHEN token='555' THEN k END),0)"
        "-CASE WHEN count(*)=343 THEN min(k) ELSE 0 END)/CAST(max(k) AS DOUBLE) AS t FROM tri GROUP BY doc_id)"
    )


PAAC_BASE = "(1+0.05::DOUBLE*avg(((p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3))/3))"
APAAC_BASE = "(1+0.05::DOUBLE*(avg(p1*q1)+avg(p2*q2)))"


def count_sql(letter: str) -> str:
    return f"sum(CASE WHEN c='{letter}' THEN 1 ELSE 0 END)"


SELECTED = X.SELECTED_NAMES
SELECTED_SQL = (
    feature_base_sql(triad_feature_sql())
    + ", "
    + place_sql("pa", L.THREE_CLASSES["hydrophobicity_ARGP820101"][0])
    + ", "
    + place_sql("pb", VOLUME[1])
    + ", "
    + place_sql("pc", L.THREE_CLASSES["hydrophobicity_FASG890101"][1])
    + ", f AS (SELECT doc_id, "
    + ", ".join(
        [
            "sum(CASE WHEN c IN ('K','R') THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE) AS \"CTDC_charge.G1\"",
            pair_sql("CKSAAP_IR.gap2", "I", "R", 2),
            dde_sql("DDE_LA", "L", "A"),
            ordered_sql("ASDC_AS", "A", "S"),
            f"{count_sql('V')}/{PAAC_BASE} AS \"PAAC_Xc1.V\"",
            f"0.05::DOUBLE*avg(p1*q1)/{APAAC_BASE} AS \"APAAC_Pc2.Hydrophobicity.1\"",
            dde_sql("DDE_LP", "L", "P"),
            pair_sql("CKSAAP_LL.gap4", "L", "L", 4),
            f"{count_sql('A')}/{APAAC_BASE} AS \"APAAC_Pc1.A\"",
            pair_sql("CKSAAGP_postivecharger.uncharger.gap1", FIRST["postivecharger"], FIRST["uncharger"], 1),
            "max(CASE WHEN pos=1 THEN z5 END) AS \"ZScale_p1.z5\"",
            f"{count_sql('T')}/(1+0.05::DOUBLE*(coalesce(sum(d1),0)+coalesce(sum(d2),0)+coalesce(sum(d3),0))) AS \"QSOrder_Grantham.Xr.T\"",
            ordered_sql("ASDC_DM", "D", "M"),
            pair_sql("CKSAAP_TR.gap4", "T", "R", 4),
            f"{count_sql('G')}/{PAAC_BASE} AS \"PAAC_Xc1.G\"",
            pair_sql("CKSAAGP_uncharger.aromatic.gap9", FIRST["uncharger"], FIRST["aromatic"], 9),
        ]
    )
    + " FROM e GROUP BY doc_id), g AS (SELECT f.*, "
    + ", ".join(
        [
            place_pick("pa", 0.5, "CTDD_hydrophobicity_ARGP820101.1.residue50"),
            place_pick("pb", 1.0, "CTDD_normwaalsvolume.2.residue100"),
            place_pick("pc", 0.5, "CTDD_hydrophobicity_FASG890101.2.residue50"),
        ]
    )
    + ", trm.t AS \"KSCTriad_g5.g5.g5.gap1\" FROM f LEFT JOIN trm USING (doc_id)"
    + place_join("pa", 0.5) + place_join("pb", 1.0) + place_join("pc", 0.5) + ")"
)


def selected_out(prefix: str = "") -> str:
    return ", ".join(f"round(\"{n}\",6) AS {X.column_name(n)}" for n in SELECTED)


@query("featurize_selected", SELECTED_SQL + f" SELECT doc_id, {selected_out()} FROM g")
def featurize_selected(spark, folder):
    out = X.counted_features(seqs(spark, folder), DOC)
    return out.select("doc_id", *[r6(F.col(f"`{n}`"), X.column_name(n)) for n in SELECTED])


@query(
    "label_feature_means",
    SELECTED_SQL
    + " SELECT l.quality, l.toxic, count(*) AS n_rows, "
    + ", ".join(f"round(avg(\"{n}\"),6) AS {X.column_name(n)}" for n in SELECTED)
    + " FROM g JOIN labels l USING (doc_id) GROUP BY l.quality, l.toxic",
)
def label_feature_means(spark, folder):
    rows = X.counted_features(labeled(spark, folder), ["quality", "toxic"])
    return rows.groupBy("quality", "toxic").agg(
        F.count("*").alias("n_rows"), *[r6(F.avg(F.col(f"`{n}`")), X.column_name(n)) for n in SELECTED]
    )


@query(
    "featurize_legacy",
    feature_base_sql()
    + ", "
    + place_sql("pa", L.THREE_CLASSES["hydrophobicity_ARGP820101"][0])
    + f", k AS (SELECT doc_id, {COUNTS_SQL} FROM ch GROUP BY doc_id)"
    ", gy AS (SELECT doc_id, CASE WHEN max(n)>2 AND var_pop(p1)*max(n)>1e-9 THEN (max(n)-1)/(2.0::DOUBLE*(max(n)-2))"
    "*sum(dd)/(var_pop(p1)*max(n)) END AS g FROM (SELECT doc_id, n, p1, (p1-lead(p1,2) OVER (PARTITION BY doc_id ORDER BY pos))"
    "*(p1-lead(p1,2) OVER (PARTITION BY doc_id ORDER BY pos)) AS dd FROM w) GROUP BY doc_id)"
    ", f AS (SELECT doc_id, sum(CASE WHEN c IN ('K','R') THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE) AS CTDC_charge_G1, "
    "avg(d1) AS SOCNumber_gGrantham_lag1, "
    + dde_sql("DDE_LA", "L", "A")
    + ", "
    + dde_sql("DDE_SP", "S", "P")
    + ", "
    + ordered_sql("ASDC_VG", "V", "G")
    + ", 1-sum(CASE WHEN contains('ALFCGIVW',c) THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE)"
    "-sum(CASE WHEN contains('RKQEND',c) THEN 1 ELSE 0 END)/CAST(max(n) AS DOUBLE) AS CTDC_solventaccess_G3, "
    f"{count_sql('V')}/{APAAC_BASE} AS APAAC_Pc1_V FROM e GROUP BY doc_id), "
    "g AS (SELECT f.*, "
    + place_pick("pa", 0.5, "CTDD_hydrophobicity_ARGP820101_1_residue50")
    + f", gy.g AS Geary_lag2, {charge_sql('7.4')} AS NetC FROM f JOIN gy USING (doc_id) JOIN k USING (doc_id)"
    + place_join("pa", 0.5) + ") "
    "SELECT doc_id, "
    + ", ".join(f"round({X.column_name(n)},6) AS {X.column_name(n)}" for n in X.LEGACY_NAMES)
    + " FROM g",
)
def featurize_legacy(spark, folder):
    out = X.featurize(seqs(spark, folder), DOC, choose=X.legacy_features)
    return out.select("doc_id", *[r6(F.col(f"`{n}`"), X.column_name(n)) for n in X.LEGACY_NAMES])
