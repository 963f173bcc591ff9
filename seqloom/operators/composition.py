"""Whole descriptor blocks as counts per string, in long form with non-zero cells only.

All counts of a block belong to one string, so they are made where the string is: a task lays the strings of a batch
end to end, numbers the tokens at every place and counts equal numbers of the same string.  Nothing is
shuffled, and one row per string and gap comes back.  What a block needs beyond its counts is array functions on
that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions.sequences import letters

# token numbers count letters from this character on
FIRST = ord("0")
#: Letters that are counted together; a longer string is counted by itself.
TOGETHER = 1 << 21
#: Strings of a batch that become Python's at a time.
SLICE = 256
#: Rows of a lookup that is sent to all tasks; a longer one is joined.
SENT = 1 << 20


class Strings:
    """Strings laid end to end: letter numbers, the string and the place of each letter, the lengths."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).astype(np.int64) - FIRST
        self._lay(codes, np.array([len(t) for t in texts], np.int64))

    @classmethod
    def of(cls, codes: np.ndarray, n: np.ndarray) -> Strings:
        """Strings whose letters are numbers already."""
        out = cls.__new__(cls)
        out._lay(codes, n)
        return out

    def _lay(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.codes, self.n = codes, n
        self.row = np.repeat(np.arange(len(n)), n)
        self.begin = np.cumsum(n) - n
        self.place = np.arange(len(self.row)) - self.begin[self.row]

    def neighbours(self, step: int, k: int = 2) -> np.ndarray:
        """Where k letters begin that stand ``step`` places apart."""
        return np.flatnonzero(self.place + (k - 1) * step < self.n[self.row])


def lists(parts: list[np.ndarray] | np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values that belong to consecutive rows, ``sizes`` of them to each."""
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(parts, kind))


def per_string(
    df: DataFrame, keys: Sequence[str], seq: Column | str, schema: str,
    run: Callable[[Strings], Iterator[tuple[np.ndarray, list]]], rows_together: int | None = None,
) -> DataFrame:
    """``run`` gives (numbers of strings, columns) for strings that were laid end to end; null strings are empty.

    At most ``rows_together`` strings are laid together, where what ``run`` holds grows with their number.
    """
    text = F.col(seq) if isinstance(seq, str) else seq
    rows = df.select(*keys, F.coalesce(text, F.lit("")).alias("_seq"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, column = batch.select(list(keys)), batch.column("_seq")
            texts, size, done = [], 0, 0
            for at in range(0, batch.num_rows, SLICE):  # only these become Python strings at a time
                for one in column.slice(at, SLICE).to_pylist():
                    texts.append(one)
                    size += len(one)
                    end = done + len(texts)
                    if size >= TOGETHER or end == batch.num_rows or len(texts) == rows_together:
                        own = held.slice(done, len(texts))
                        for which, columns in run(Strings(texts)):
                            taken = [c.take(pa.array(which)) for c in own.columns]
                            yield pa.RecordBatch.from_arrays([*taken, *columns], [*keys, *names])
                        texts, size, done = [], 0, end

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(task, kinds + schema)


def code_lists(
    df: DataFrame, keys: Sequence[str], k: int = 1, gaps: Sequence[int] = (0,), seq: Column | str = "seq"
) -> DataFrame:
    """One row per string and gap that has a token: keys, gap, places, codes, counts.

    A token is ``k`` letters that stand ``gap`` apart, as a number with six bits a letter; a gap of -1 takes one
    letter k times.
    """

    def run(s: Strings):
        for gap in gaps:
            step = gap + 1
            at = s.neighbours(step, k)
            if not len(at):
                continue
            code = s.codes[at]
            for j in range(1, k):
                code = code * 64 + s.codes[at + j * step]
            cell, n = np.unique(s.row[at] << 6 * k | code, return_counts=True)
            which, sizes = np.unique(cell >> 6 * k, return_counts=True)
            yield which, [
                pa.array(np.full(len(which), gap, np.int32)),
                pa.array((s.n[which] - (k - 1) * step).astype(np.int32)),
                lists(cell & (1 << 6 * k) - 1, sizes, pa.int32()),
                lists(n, sizes, pa.int64()),
            ]

    return per_string(df, keys, seq, "gap int, places int, codes array<int>, counts array<long>", run)


def token_positions(
    df: DataFrame, keys: Sequence[str], k: int = 1, gaps: Sequence[int] = (0,), seq: Column | str = "seq"
) -> DataFrame:
    """One row per token of ``k`` letters that stand ``gap`` apart: keys, gap, places, pos, token."""
    text = F.col(seq) if isinstance(seq, str) else seq
    rows = df.select(*keys, text.alias("_seq"))
    rows = rows.select(*keys, F.length("_seq").alias("_n"), letters("_seq").alias("_letters"))
    rows = rows.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps])))
    rows = rows.withColumn("places", F.col("_n") - (k - 1) * (F.col("gap") + 1)).filter("places > 0")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("places"))))
    parts = [F.element_at("_letters", F.col("pos") + j * (F.col("gap") + 1)) for j in range(k)]
    return rows.select(*keys, "gap", "places", "pos", F.concat(*parts).alias("token"))


def code_letter(code: Column | str, k: int, j: int) -> Column:
    """The j-th of the k letters in a token number."""
    c = F.col(code) if isinstance(code, str) else code
    return F.chr(F.shiftright(c, 6 * (k - 1 - j)).bitwiseAND(F.lit(63)) + FIRST)


def letter_code(letter: str) -> int:
    return ord(letter) - FIRST


def cells(codes: Column | str = "codes", counts: Column | str = "counts") -> Column:
    """Generator of (code, n) rows from the two lists."""
    pair = F.arrays_zip(F.col(codes) if isinstance(codes, str) else codes, F.col(counts) if isinstance(counts, str) else counts)
    return F.inline(pair).alias("code", "n")


def token_of(code: Column | str, k: int) -> Column:
    return F.concat(*[code_letter(code, k, j) for j in range(k)])


def token_counts(
    df: DataFrame, keys: Sequence[str], k: int = 1, gaps: Sequence[int] = (0,), seq: Column | str = "seq"
) -> DataFrame:
    """Occurrences per token: keys, gap, places, token, n."""
    rows = code_lists(df, keys, k, gaps, seq).select(*keys, "gap", "places", cells())
    return rows.select(*keys, "gap", "places", token_of("code", k).alias("token"), "n")


def kmer_frequency(
    df: DataFrame, keys: Sequence[str], k: int, seq: Column | str = "seq"
) -> DataFrame:
    """Share of each k-letter token among all its positions (k = 1, 2, 3: AAC, DPC, TPC)."""
    counts = token_counts(df, keys, k, (0,), seq)
    return counts.select(*keys, "token", (F.col("n") / F.col("places")).alias("value"))


def gapped_pair_frequency(
    df: DataFrame, keys: Sequence[str], kspace: int, seq: Column | str = "seq"
) -> DataFrame:
    """Share of each letter pair at each gap 0..kspace (CKSAAP)."""
    counts = token_counts(df, keys, 2, range(kspace + 1), seq)
    return counts.select(*keys, "gap", "token", (F.col("n") / F.col("places")).alias("value"))


def group_kmer_frequency(df: DataFrame, keys: Sequence[str], k: int, groups: dict[str, str]) -> DataFrame:
    """As `kmer_frequency` over group digits (GAAC, GDPC, GTPC)."""
    return kmer_frequency(df, keys, k, L.recode(F.col("seq"), list(groups.values())))


def group_gapped_pair_frequency(
    df: DataFrame, keys: Sequence[str], kspace: int, groups: dict[str, str]
) -> DataFrame:
    """Group pairs at each gap (CKSAAGP)."""
    return gapped_pair_frequency(df, keys, kspace, L.recode(F.col("seq"), list(groups.values())))


def pair_deviation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deviation of every adjacent pair from its codon expectation, all 400 cells (DDE).

    A pair that never occurs has a non-zero deviation too, so a string's counts are a dense list.  A string of fewer
    than two letters has no pairs and no rows.
    """
    size = len(L.LETTERS)
    number = np.full(64, -1)
    number[[letter_code(a) for a in L.LETTERS]] = np.arange(size)

    def run(s: Strings):
        which = np.flatnonzero(s.n > 1)
        if not len(which):
            return
        at = s.neighbours(1)
        a, b = number[s.codes[at]], number[s.codes[at + 1]]
        known = (a >= 0) & (b >= 0)
        n = np.bincount((s.row[at] * size * size + a * size + b)[known], minlength=len(s.n) * size * size)
        n = n.reshape(-1, size * size)[which]
        yield which, [pa.array((s.n[which] - 1).astype(np.int32)), lists(n.ravel(), np.full(len(which), size * size), pa.int64())]

    codons = [(a + b, (L.CODONS[a] / 61) * (L.CODONS[b] / 61)) for a in L.LETTERS for b in L.LETTERS]
    expected = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(tm).alias("tm")) for t, tm in codons])
    rows = per_string(df, keys, "seq", "places int, counts array<long>", run)
    pair = F.zip_with(
        expected, "counts", lambda e, n: F.struct(e["token"].alias("token"), e["tm"].alias("tm"), n.alias("n"))
    )
    tv = F.col("tm") * (1 - F.col("tm")) / F.col("places")
    return rows.select(*keys, "places", F.inline(pair)).select(
        *keys, "token", ((F.col("n") / F.col("places") - F.col("tm")) / F.sqrt(tv)).alias("value")
    )


def scaled_triples(
    df: DataFrame, keys: Sequence[str], groups: dict[str, str], gaps: Sequence[int] = (0,)
) -> DataFrame:
    """(n - min) / max over all group triples, per gap (CTriad, KSCTriad); non-empty cells.

    The minimum runs over every possible cell, so it is zero unless all occur.
    """
    rows = code_lists(df, keys, 3, gaps, L.recode(F.col("seq"), list(groups.values())))
    least = F.when(F.size("codes") == len(groups) ** 3, F.array_min("counts")).otherwise(F.lit(0))
    rows = rows.select(*keys, "gap", least.alias("_least"), F.array_max("counts").alias("_most"), cells())
    return rows.select(
        *keys, "gap", token_of("code", 3).alias("token"), ((F.col("n") - F.col("_least")) / F.col("_most")).alias("value")
    )


def pairs_in_order(s: Strings, i: int) -> np.ndarray:
    """How often each letter stands before each other one in the i-th string; letters by letters."""
    own = np.array([letter_code(a) for a in L.LETTERS])
    pairs, seen = np.zeros((len(own), len(own))), np.zeros(len(own))
    for start in range(0, int(s.n[i]), 1 << 16):
        end = min(start + (1 << 16), int(s.n[i]))
        marks = (s.codes[s.begin[i] + start : s.begin[i] + end, None] == own).astype(np.float64)
        pairs += (np.cumsum(marks, axis=0) - marks + seen).T @ marks
        seen += marks.sum(0)
    return pairs


def ordered_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of position pairs i < j per ordered letter pair (ASDC).

    Running counts of the letters stand beside each position; summed per second letter they give all pairs in time
    proportional to the length, and no pair of positions is ever written out.
    """
    own = np.array([letter_code(a) for a in L.LETTERS])
    code = (own[:, None] * 64 + own[None, :]).ravel()

    def run(s: Strings):
        which, counts, codes, sizes = [], [], [], []
        for i in np.flatnonzero(s.n > 1):
            pairs = pairs_in_order(s, i)
            full = np.flatnonzero(pairs.ravel())
            which.append(i)
            codes.append(code[full])
            counts.append(pairs.ravel()[full])
            sizes.append(len(full))
        if which:
            n = np.concatenate(counts).astype(np.int64)
            yield np.array(which), [
                pa.array(s.n[which].astype(np.int32)), lists(np.concatenate(codes), np.array(sizes), pa.int32()),
                lists(n, np.array(sizes), pa.int64()),
            ]

    rows = per_string(df, keys, "seq", "places int, codes array<int>, counts array<long>", run)
    n = F.col("places").cast("double")
    return rows.select(*keys, "places", cells()).select(
        *keys, token_of("code", 2).alias("token"), (F.col("n") / (n * (n - 1) / 2)).alias("value")
    )


def class_transitions(df: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Share of neighbours that belong to two given classes, in either order (CTDT); three cells."""
    rows = code_lists(df, keys, 2, (0,), L.recode(F.col("seq"), list(classes)))

    def share(a: str, b: str) -> Column:
        either = [letter_code(a) * 64 + letter_code(b), letter_code(b) * 64 + letter_code(a)]
        hits = F.zip_with("codes", "counts", lambda c, n: F.when(c.isin(*either), n).otherwise(F.lit(0)))
        return F.aggregate(hits, F.lit(0).cast("long"), lambda x, y: x + y) / F.col("places")

    found = [F.struct(F.lit(a + b).alias("token"), share(a, b).alias("value")) for a, b in ("12", "13", "23")]
    return rows.select(*keys, F.inline(F.array(*found)))


def window_composition(
    df: DataFrame, keys: Sequence[str], width: int, seq: Column | str = "seq"
) -> DataFrame:
    """Share of each token inside every sliding window of ``width`` letters (EAAC, EGAAC).

    Each row holds its window as a short array; equal letters in it are counted in
    place, so the windows are not grouped again.
    """
    rows = token_positions(df, keys, width, (0,), seq)
    rows = rows.select(*keys, F.col("pos").alias("window"), F.col("token").alias("_w"))
    rows = rows.select(*keys, "window", "_w", F.explode(F.array_distinct(letters("_w"))).alias("token"))
    hits = F.length("_w") - F.length(F.replace(F.col("_w"), F.col("token"), F.lit("")))
    return rows.select(*keys, "window", "token", (hits / width).alias("value"))


def positional_values(df: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """Property values per position (AAIndex, ZScale, matrix rows); ``table`` is (prop, letter, value).

    A lookup has one row per letter and property and is sent to all tasks, unless it is longer than SENT rows.
    """
    rows = token_positions(df, keys)
    lookup = F.broadcast(table) if table.limit(SENT + 1).count() <= SENT else table
    return rows.join(lookup, rows.token == lookup.letter).select(*keys, "pos", "prop", "value")
