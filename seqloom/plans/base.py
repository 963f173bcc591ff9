"""The query registry and the derived views the queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions.sequences import clean_letters
from seqloom.session import spread_rows
from seqloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL it must agree with."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(column, name: str | None = None):
    """Six decimals, and no negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


# ---- derived views, in Spark ------------------------------------------------

def cleaned(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, seq): texts reduced to the alphabet; every row stays, a null text or one without a letter is empty.

    What short strings give: a block has rows only for places that exist, so a string shorter than a token, a lag or a
    window has none there; a share of nothing, a ratio with a flat property and a quantile of no letter are as each
    operator says, null unless the published value is zero.
    """
    # the array keeps the cleaning from being repeated wherever the string is used
    return df.select(*keys, F.explode(F.array(F.coalesce(clean_letters(text), F.lit("")))).alias("seq"))


#: Rows of labels that are sent to all tasks; more are joined.
SENT = 1 << 21


def seqs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(doc_id, other columns, seq): whole texts reduced to the alphabet."""
    docs = spread_rows(read_table(spark, folder, "documents").select("doc_id", *columns, "text"), "doc_id")
    return cleaned(docs, "text", "doc_id", *columns)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, seq): whole conversation turns."""
    rows = spread_rows(read_table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return cleaned(rows, "text", "conv_id", "turn")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, seq)."""
    rows = read_table(spark, folder, "benchmark")
    return cleaned(rows, "text", "item_id")


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, seq): part names, the short strings of the data."""
    rows = read_table(spark, folder, "part").select("p_partkey", "p_name")
    return cleaned(rows, "p_name", "p_partkey")


def labeled(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(doc_id, other columns, seq, quality, toxic); the texts stay where they are while the labels are few."""
    labels = read_table(spark, folder, "labels")
    few = labels.count() <= SENT
    return seqs(spark, folder, *columns).join(F.broadcast(labels) if few else labels, "doc_id")


# ---- the same views, in SQL -------------------------------------------------

def _clean(text: str) -> str:
    return f"regexp_replace(upper(regexp_replace(coalesce({text},''),'[^A-Za-z]','','g')),'[BJOUXZ]','','g')"


SEQS = f"seqs AS (SELECT doc_id, {_clean('text')} AS seq FROM documents)"
TURNS = f"turns AS (SELECT conv_id, turn, {_clean('text')} AS seq FROM conversations)"
ITEMS = f"items AS (SELECT item_id, {_clean('text')} AS seq FROM benchmark)"
NAMES = f"names AS (SELECT p_partkey, {_clean('p_name')} AS seq FROM part)"
LABELED = f"{SEQS}, labeled AS (SELECT s.doc_id, s.seq, l.quality, l.toxic FROM seqs s JOIN labels l USING (doc_id))"


def chars(view: str, keys: str) -> str:
    """CTE ``ch``: one row per letter position."""
    return (
        f"ch AS (SELECT {keys}, n, c, pos FROM (SELECT {keys}, length(seq) AS n, "
        f"unnest(string_split(seq,'')) AS c, unnest(range(1, length(seq)+1)) AS pos FROM {view} WHERE seq <> ''))"
    )


def values(rows, columns: str, name: str) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    body = ",".join("(" + ",".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def props_sql(rows: dict[str, dict[str, float]], name: str = "props") -> str:
    return values([(p, a, float(v)) for p, r in rows.items() for a, v in r.items()], "prop, letter, v", name)


def distance_sql(name: str = "dist") -> str:
    return values([(a, b, float(d)) for (a, b), d in L.grantham().items()], "a, b, d", name)
