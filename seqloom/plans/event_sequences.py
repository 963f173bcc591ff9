"""Event logs as sequences: one letter per event, ordered per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import symbols as Y
from seqloom.plans.base import query, r6
from seqloom.sources.tables import read_table

CODES = {"signup": "S", "purchase": "P", "error": "E", "view": "V", "click": "C"}
ORDER = ["ts", "event_id"]


def coded(spark, folder):
    rows = read_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    letter = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(code)) for name, code in CODES.items()])
    return rows.select("user_id", "ts", "event_id", letter.alias("symbol")).filter("symbol is not null")


def numbered(spark, folder):
    return Y.numbered_symbols(coded(spark, folder), "user_id", ORDER, "symbol")


EV = (
    "ev AS (SELECT user_id, ts, event_id, CASE event_type "
    + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in CODES.items())
    + " END AS s FROM events WHERE event_type IN ("
    + ",".join(f"'{n}'" for n in CODES)
    + "))"
)
LEADS = ", ".join(f"lead(s,{d}) OVER w AS s{d}" for d in range(1, 6))
LED = f"{EV}, ld AS (SELECT user_id, s, {LEADS} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def share_sql(token: str, where: str, gap: str | None = None) -> str:
    extra = "" if gap is None else f", {gap} AS gap"
    return (
        f"SELECT user_id, {token} AS token, round(count(*)/CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE),6) AS value{extra} "
        f"FROM ld WHERE {where} GROUP BY user_id, {token}"
    )


@query("event_aac", f"WITH {LED} " + share_sql("s", "true"))
def event_aac(spark, folder):
    return Y.symbol_frequency(coded(spark, folder), "user_id", "symbol").select("user_id", "token", r6("value"))


@query("event_dpc", f"WITH {LED} " + share_sql("s||s1", "s1 IS NOT NULL"))
def event_dpc(spark, folder):
    return Y.symbol_kmer_frequency(numbered(spark, folder), "user_id", 2).select("user_id", "token", r6("value"))


@query("event_tpc", f"WITH {LED} " + share_sql("s||s1||s2", "s2 IS NOT NULL"))
def event_tpc(spark, folder):
    return Y.symbol_kmer_frequency(numbered(spark, folder), "user_id", 3).select("user_id", "token", r6("value"))


@query(
    "event_cksaap",
    f"WITH {LED} " + " UNION ALL ".join(share_sql(f"s||s{g + 1}", f"s{g + 1} IS NOT NULL", f"CAST({g} AS INTEGER)") for g in range(5)),
)
def event_cksaap(spark, folder):
    return Y.symbol_gapped_pairs(numbered(spark, folder), "user_id", 4).select("user_id", "token", r6("value"), "gap")


@query(
    "event_transitions",
    f"WITH {LED}, t AS (SELECT user_id, least(s,s1)||greatest(s,s1) AS token, s<>s1 AS d, count(*) AS n FROM ld WHERE s1 IS NOT NULL GROUP BY 1,2,3), "
    "r AS (SELECT *, n/CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS v FROM t) SELECT user_id, token, round(v,6) AS value FROM r WHERE d",
)
def event_transitions(spark, folder):
    return Y.symbol_transitions(numbered(spark, folder), "user_id").select("user_id", "token", r6("value"))


@query(
    "event_asdc",
    f"WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ev) "
    "SELECT a.user_id, a.s||b.s AS token, round(count(*)/(max(a.n)*(max(a.n)-1)/2.0::DOUBLE),6) AS value FROM o a JOIN o b ON b.user_id=a.user_id AND b.pos>a.pos GROUP BY 1,2",
)
def event_asdc(spark, folder):
    out = Y.symbol_ordered_pairs(coded(spark, folder), "user_id", ORDER, "symbol", list(CODES.values()))
    return out.select("user_id", "token", r6("value"))
