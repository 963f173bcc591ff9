"""Descriptors that compare a letter with the one ``lag`` places on.

Each is made of sums of f(a, b) over neighbours of one string.  A task looks the letters of a batch of strings up
once, multiplies shifted arrays and adds up per string, so a string becomes one row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.operators.composition import Strings, code_letter, letter_code, lists, per_string

_SUM_FIELDS = ("s_ab", "s_a", "s_b", "s_aa", "s_dd", "mean_a", "mean_b", "s_aa_all")
_SUMS = "array<struct<prop:string,prop2:string,lag:int,places:int,size:int," + ",".join(f"{f}:double" for f in _SUM_FIELDS) + ">>"


def _letter_lists(s: Strings, which: np.ndarray) -> list[pa.Array]:
    """Codes and counts of the letters of each string in ``which``, which are those with letters."""
    cell, n = np.unique(s.row << 6 | s.codes, return_counts=True)
    sizes = np.unique(cell >> 6, return_counts=True)[1]
    return [lists(cell & 63, sizes, pa.int32()), lists(n, sizes, pa.int64())]


def lag_rows(
    df: DataFrame, keys: Sequence[str], rows: dict[str, dict[str, float]], nlag: int, cross: bool = False
) -> DataFrame:
    """One row per string with letters: keys, codes, counts, sums.

    ``sums`` has, for each property pair and each lag that the string is long enough for, the sums every lag
    descriptor is made of; ``size``, the means and ``s_aa_all`` are whole-string values.
    """
    names = list(rows)
    value = np.zeros((len(names), 64))
    for i, p in enumerate(names):
        value[i, [letter_code(a) for a in L.LETTERS]] = [rows[p][a] for a in L.LETTERS]
    pairs = [(i, j) for i in range(len(names)) for j in (range(len(names)) if cross else [i])]

    def run(s: Strings):
        which = np.flatnonzero(s.n > 0)
        if not len(which):
            return
        v = value[:, s.codes]
        total = lambda r, x: np.bincount(r, x, len(s.n))
        whole = [total(s.row, x) for x in v]
        square = [total(s.row, x * x) for x in v]
        mean = [x / np.maximum(s.n, 1) for x in whole]
        columns: dict[str, list] = {c: [] for c in ("row", "prop", "prop2", "lag", "places", "size", *_SUM_FIELDS)}
        for lag in range(1, nlag + 1):
            at = s.neighbours(lag)
            r = s.row[at]
            long = np.flatnonzero(s.n > lag)
            for i, j in pairs:
                a, b = v[i][at], v[j][at + lag]
                sums = [total(r, x)[long] for x in (a * b, a, b, a * a, (a - b) * (a - b))]
                sums += [mean[i][long], mean[j][long], square[i][long]]
                ones = np.ones(len(long), np.int32)
                for c, x in zip(columns, [long, i * ones, j * ones, lag * ones, s.n[long] - lag, s.n[long], *sums]):
                    columns[c].append(x)
        flat = {c: np.concatenate(x) if x else np.zeros(0) for c, x in columns.items()}
        order = np.argsort(flat["row"], kind="stable")
        sizes = np.bincount(flat["row"].astype(np.int64), minlength=len(s.n))[which]
        text = pa.array(names, pa.string())
        fields = [text.take(pa.array(flat[c][order].astype(np.int64))) for c in ("prop", "prop2")]
        fields += [pa.array(flat[c][order].astype(np.int32)) for c in ("lag", "places", "size")]
        fields += [pa.array(flat[c][order].astype(np.float64)) for c in _SUM_FIELDS]
        struct = pa.StructArray.from_arrays(fields, ["prop", "prop2", "lag", "places", "size", *_SUM_FIELDS])
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield which, [*_letter_lists(s, which), pa.ListArray.from_arrays(ends, struct)]

    return per_string(df, keys, "seq", f"codes array<int>, counts array<long>, sums {_SUMS}", run)


def lag_sums(
    df: DataFrame, keys: Sequence[str], rows: dict[str, dict[str, float]], nlag: int, cross: bool = False
) -> DataFrame:
    """The sums of `lag_rows`, one row per key, property pair and lag."""
    return lag_rows(df, keys, rows, nlag, cross).select(*keys, F.inline("sums"))


def _centred_product() -> Column:
    """Mean over neighbours of (P_i - m)(Q_{i+lag} - m')."""
    c = F.col
    total = c("s_ab") - c("mean_b") * c("s_a") - c("mean_a") * c("s_b") + c("places") * c("mean_a") * c("mean_b")
    return total / c("places")


def _spread() -> Column:
    """Sum over the string of (P_i - m)^2."""
    return F.col("s_aa_all") - F.col("size") * F.col("mean_a") * F.col("mean_a")


def _unless_flat(value: Column) -> Column:
    """Null where the string's property does not vary, as the ratio is undefined."""
    return F.when(_spread() > 1e-9, value)


def moran(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    value = _unless_flat(_centred_product() / (_spread() / F.col("size")))
    return lag_sums(df, keys, rows, nlag).select(*keys, "prop", "lag", value.alias("value"))


def geary(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    """Null where the string is not longer than the largest lag."""
    c = F.col
    ratio = (c("size") - 1) / (2 * c("places")) * c("s_dd") / _spread()
    value = F.when(c("size") > nlag, _unless_flat(ratio))
    return lag_sums(df, keys, rows, nlag).select(*keys, "prop", "lag", value.alias("value"))


def normalized_moreau_broto(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    value = F.col("s_ab") / F.col("places")
    return lag_sums(df, keys, rows, nlag).select(*keys, "prop", "lag", value.alias("value"))


def auto_covariance(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    sums = lag_sums(df, keys, rows, nlag)
    return sums.select(*keys, "prop", "prop2", "lag", _centred_product().alias("value"))


def cross_covariance(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    sums = lag_sums(df, keys, rows, nlag, cross=True).filter("prop <> prop2")
    return sums.select(*keys, "prop", "prop2", "lag", _centred_product().alias("value"))


def auto_cross_covariance(df: DataFrame, keys: Sequence[str], rows, nlag: int) -> DataFrame:
    """Both of the above from one pass over the strings."""
    sums = lag_sums(df, keys, rows, nlag, cross=True)
    return sums.select(*keys, "prop", "prop2", "lag", _centred_product().alias("value"))


def _coupling(df: DataFrame, keys: Sequence[str], distances, nlag: int) -> DataFrame:
    """One row per string with letters: keys, codes, counts, lags (lag, places, total of squared distances)."""
    square = np.zeros((64, 64))
    for (a, b), d in distances.items():
        square[letter_code(a), letter_code(b)] = float(d) ** 2

    def run(s: Strings):
        which = np.flatnonzero(s.n > 0)
        if not len(which):
            return
        row, lag, places, total = [], [], [], []
        for step in range(1, nlag + 1):
            at = s.neighbours(step)
            long = np.flatnonzero(s.n > step)
            row.append(long)
            lag.append(np.full(len(long), step))
            places.append(s.n[long] - step)
            total.append(np.bincount(s.row[at], square[s.codes[at], s.codes[at + step]], len(s.n))[long])
        row, lag, places, total = map(np.concatenate, (row, lag, places, total))
        order = np.argsort(row, kind="stable")
        struct = pa.StructArray.from_arrays(
            [pa.array(lag[order].astype(np.int32)), pa.array(places[order].astype(np.int32)), pa.array(total[order])],
            ["lag", "places", "total"],
        )
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(s.n))[which])).astype(np.int32))
        yield which, [*_letter_lists(s, which), pa.ListArray.from_arrays(ends, struct)]

    schema = "codes array<int>, counts array<long>, lags array<struct<lag:int,places:int,total:double>>"
    return per_string(df, keys, "seq", schema, run)


def order_coupling(df: DataFrame, keys: Sequence[str], distances, nlag: int) -> DataFrame:
    """Sum of squared letter distances per lag, and its mean over neighbours (SOCNumber)."""
    rows = _coupling(df, keys, distances, nlag).select(*keys, F.inline("lags"))
    return rows.select(*keys, "lag", "total", (F.col("total") / F.col("places")).alias("value"))


def _with_letters(rows: DataFrame, keys: Sequence[str], base: Column, name: str, terms: Column) -> DataFrame:
    """Letter counts over ``base`` and the string's own terms (feature, value), as rows."""
    letters = F.zip_with(
        "codes", "counts",
        lambda c, n: F.struct(F.concat(F.lit(f"{name}."), code_letter(c, 1, 0)).alias("feature"), (n / F.col("_base")).alias("value")),
    )
    based = rows.select("*", base.alias("_base"))
    return based.select(*keys, F.inline(F.concat(letters, terms)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def quasi_sequence_order(
    df: DataFrame, keys: Sequence[str], distances, nlag: int = 3, weight: float = 0.05
) -> DataFrame:
    """Letter counts (Xr) and lag terms (Xd) over 1 + weight * sum of the lag totals (QSOrder)."""
    base = 1 + weight * _total(F.transform("lags", lambda x: x["total"]))
    terms = F.transform(
        "lags",
        lambda x: F.struct(
            F.concat(F.lit("Xd."), x["lag"].cast("string")).alias("feature"), (weight * x["total"] / F.col("_base")).alias("value")
        ),
    )
    return _with_letters(_coupling(df, keys, distances, nlag), keys, base, "Xr", terms)


def pseudo_composition(
    df: DataFrame, keys: Sequence[str], rows, lag: int = 1, weight: float = 0.05
) -> DataFrame:
    """Letter counts over 1 + weight * theta (PAAC); theta averages squared property differences.

    A string of one letter has no theta and no rows.
    """
    sums = lag_rows(df, keys, {p: L.standardized(r) for p, r in rows.items()}, lag).filter(F.size("sums") > 0)

    def theta(of: Column) -> Column:
        return _total(F.transform(of, lambda x: x["s_dd"] / x["places"])) / len(rows)

    reached = F.array_distinct(F.transform("sums", lambda x: x["lag"]))
    terms = F.transform(
        reached,
        lambda n: F.struct(
            F.concat(F.lit("Xc2.lambda"), n.cast("string")).alias("feature"),
            (weight * theta(F.filter("sums", lambda x: x["lag"] == n)) / F.col("_base")).alias("value"),
        ),
    )
    return _with_letters(sums, keys, 1 + weight * theta(F.col("sums")), "Xc1", terms)


def amphiphilic_pseudo_composition(
    df: DataFrame, keys: Sequence[str], rows, lag: int = 1, weight: float = 0.05
) -> DataFrame:
    """As above with products, one theta per property (APAAC)."""
    sums = lag_rows(df, keys, {p: L.standardized(r) for p, r in rows.items()}, lag).filter(F.size("sums") > 0)
    terms = F.transform(
        "sums",
        lambda x: F.struct(
            F.concat(F.lit("Pc2."), x["prop"], F.lit("."), x["lag"].cast("string")).alias("feature"),
            (weight * x["s_ab"] / x["places"] / F.col("_base")).alias("value"),
        ),
    )
    base = 1 + weight * _total(F.transform("sums", lambda x: x["s_ab"] / x["places"]))
    return _with_letters(sums, keys, base, "Pc1", terms)
