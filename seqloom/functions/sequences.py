"""Row-local expressions over one string: no shuffle, no UDF."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import flat
from seqloom.functions import lookups as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_letters(text: Column | str) -> Column:
    """The letters of a text that belong to the 20-letter alphabet, in upper case."""
    return F.upper(F.regexp_replace(col(text), f"[^{L.LETTERS}{L.LETTERS.lower()}]+", ""))


def letters(seq: Column | str) -> Column:
    """The letters as an array; an empty string has none."""
    return F.when(col(seq) == "", F.array().cast("array<string>")).otherwise(F.split(col(seq), ""))


def count_in(seq: Column | str, members: str) -> Column:
    """How many letters of ``seq`` belong to ``members``."""
    s = col(seq)
    return F.length(s) - F.length(F.translate(s, members, ""))


def class_fraction(seq: Column | str, members: str) -> Column:
    return F.try_divide(count_in(seq, members), F.length(col(seq)))


def rest_fraction(seq: Column | str, first: str, second: str) -> Column:
    """The share of the third class, as what the first two leave over."""
    return 1 - class_fraction(seq, first) - class_fraction(seq, second)


def class_quantile_position(seq: Column | str, members: str, share: float) -> Column:
    """Where the member that completes ``share`` of the class sits, in percent of the length.

    ``share`` 0 means the first member.  An absent class gives 0.  All members become
    one mark, and what precedes the n-th mark is cut off and measured.
    """
    n = count_in(seq, members)
    nth = F.greatest(F.lit(1), F.floor(F.lit(share) * n)).cast("int")
    marked = F.translate(col(seq), members, "*" * len(members))
    before = F.call_function("substring_index", marked, F.lit("*"), nth)
    return F.when(n == 0, F.lit(0.0)).otherwise((F.length(before) + 1) / F.length(col(seq)) * 100)


def gapped_pair_fraction(seq: Column | str, first: str, second: str, gap: int) -> Column:
    """Share of positions where a letter of ``first`` is followed, ``gap`` letters on, by one of ``second``."""
    s = col(seq)
    places = F.length(s) - gap - 1
    # only the first letter is consumed, so overlapping pairs are all counted
    pattern = f"[{first}](?={'.' * gap}[{second}])"
    return F.when(places > 0, F.try_divide(F.regexp_count(s, F.lit(pattern)), places)).otherwise(F.lit(0.0))


def pair_expectation_score(seq: Column | str, first: str, second: str) -> Column:
    """Deviation of an adjacent pair's share from what codon counts let expect."""
    expected = (L.CODONS[first] / 61) * (L.CODONS[second] / 61)
    places = F.greatest(F.length(col(seq)) - 1, F.lit(0))
    observed = gapped_pair_fraction(seq, first, second, 0)
    return (observed - expected) / F.sqrt(F.try_divide(F.lit(expected * (1 - expected)), places))


def ordered_pair_fraction(seq: Column | str, first: str, second: str) -> Column:
    """Share of all position pairs i < j with ``first`` at i and ``second`` at j; one pass."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("pairs"))
    # letters that are neither cannot change the count: leave them out before folding
    kept = F.regexp_replace(col(seq), f"[^{first}{second}]", "")
    state = F.aggregate(
        letters(kept),
        start,
        lambda acc, x: F.struct(
            (acc["seen"] + F.when(x == first, 1).otherwise(0)).alias("seen"),
            (acc["pairs"] + F.when(x == second, acc["seen"]).otherwise(0)).alias("pairs"),
        ),
    )
    n = F.length(col(seq)).cast("double")
    return F.when(n >= 2, state["pairs"] / (n * (n - 1) / 2))


def letter_codes(seq: Column | str) -> Column:
    """A = 1 ... Z = 26 per position, as an array of ints."""
    return F.transform(letters(seq), lambda x: F.ascii(x) - 64)


def pair_codes(codes: Column | str, n: Column | str, lag: int) -> Column:
    """One number per position that has a letter ``lag`` places on."""
    places = F.greatest(col(n) - lag, F.lit(0))
    first, second = F.slice(codes, F.lit(1), places), F.slice(codes, F.lit(lag + 1), places)
    return F.zip_with(first, second, lambda a, b: a * 27 + b)


def table_sum(numbers: Column | str, table: dict[int, float]) -> Column:
    """Sum of the table's values over an array of codes."""
    cells = L.array_literal(float(table.get(i, 0.0)) for i in range(1, max(table) + 1))
    return F.aggregate(numbers, F.lit(0.0), lambda acc, i: acc + F.element_at(cells, i))


def pair_values(combine) -> dict[int, float]:
    """The value of ``combine(a, b)`` for every letter pair, by pair code."""
    return {(ord(a) - 64) * 27 + ord(b) - 64: float(combine(a, b)) for a in L.LETTERS for b in L.LETTERS}


def letter_values(row: dict[str, float]) -> dict[int, float]:
    return {ord(a) - 64: float(v) for a, v in row.items()}


def hamming(a: Column | str, b: Column | str, batched: bool = False) -> Column:
    """Positions that differ, over the shorter length; ``batched`` is for many short strings."""
    if batched:

        @F.arrow_udf("int")
        def differing(first: pa.Array, second: pa.Array) -> pa.Array:
            return flat.by_pieces(flat.differing, pa.int32(), first, second)

        return differing(col(a), col(b))
    n = F.least(F.length(col(a)), F.length(col(b)))
    differs = F.zip_with(
        F.slice(letters(a), F.lit(1), n), F.slice(letters(b), F.lit(1), n), lambda x, y: x != y
    )
    return F.when(n > 0, F.size(F.filter(differs, lambda d: d))).otherwise(F.lit(0))


def terminal_reduce(seq: Column | str) -> Column:
    """First letter and the last five."""
    s = col(seq)
    return F.concat(F.substring(s, 1, 1), F.right(s, F.lit(5)))


def net_charge(seq: Column | str, ph: Column | float = 7.4) -> Column:
    """Henderson-Hasselbalch sum over ionizable letters and both ends."""
    s = col(seq)
    acid = F.lit(ph) if isinstance(ph, (int, float)) else ph
    total = F.lit(0.0)
    for name, pk in L.PK_POSITIVE.items():
        n = F.lit(1) if name == "n_end" else count_in(s, name)
        total = total + n / (1 + F.pow(F.lit(10.0), acid - pk))
    for name, pk in L.PK_NEGATIVE.items():
        n = F.lit(1) if name == "c_end" else count_in(s, name)
        total = total - n / (1 + F.pow(F.lit(10.0), F.lit(pk) - acid))
    return total


def letter_sum(
    seq: Column | str, contribution: dict[str, float], constant: float = 0.0, batched: bool = False
) -> Column:
    """A constant plus one contribution per letter occurrence; counts, so one pass per letter used, or, ``batched``,
    one pass over all strings of a batch."""
    if batched:

        @F.arrow_udf("double")
        def total_of(texts: pa.Array) -> pa.Array:
            return flat.by_pieces(lambda t: flat.letter_total(t, contribution, constant), pa.float64(), texts)

        return total_of(col(seq))
    total = F.lit(float(constant))
    for letter, value in contribution.items():
        if value:
            total = total + count_in(seq, letter) * F.lit(float(value))
    return total


def triple_codes(codes: Column | str, n: Column | str, groups: dict[str, str], gap: int) -> Column:
    """Sorted numbers of the group triples whose letters stand ``gap`` apart."""
    order = {letter: i for i, members in enumerate(groups.values()) for letter in members}
    group = L.array_literal((order.get(chr(64 + i), 0) for i in range(1, 27)), "int")
    size, step = len(groups), gap + 1
    places = F.greatest(col(n) - 2 * step, F.lit(0))
    firsts = F.zip_with(
        F.slice(codes, F.lit(1), places),
        F.slice(codes, F.lit(1 + step), places),
        lambda a, b: F.element_at(group, a) * size + F.element_at(group, b),
    )
    triples = F.zip_with(
        firsts, F.slice(codes, F.lit(1 + 2 * step), places), lambda ab, c: ab * size + F.element_at(group, c)
    )
    return F.sort_array(triples)


def run_starts(ordered: str) -> Column:
    """Where each run of equal values begins in a sorted array column, and one past the end."""
    column = F.col(ordered)
    n = F.size(column)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(column, i) != F.get(column, i - 1)))
    return F.when(n > 0, F.concat(starts, F.array(n))).otherwise(F.array().cast("array<int>"))


def spaced_triple_score(
    seq: Column | str, starts: Column | str, groups: dict[str, str], triple: tuple[str, str, str], gap: int
) -> Column:
    """(n - min) / max over all group triples, of which ``starts`` marks the runs; null without triples."""
    # only the first letter is consumed, so overlapping triples are all counted
    between = "." * gap
    first, second, third = (groups[g] for g in triple)
    hits = F.regexp_count(col(seq), F.lit(f"[{first}](?={between}[{second}]{between}[{third}])"))
    kinds = F.size(starts) - 1
    sizes = F.zip_with(
        F.slice(starts, F.lit(1), F.greatest(kinds, F.lit(0))),
        F.slice(starts, F.lit(2), F.greatest(kinds, F.lit(0))),
        lambda a, b: b - a,
    )
    # a cell that never occurs makes the minimum zero
    least = F.when(kinds == len(groups) ** 3, F.array_min(sizes)).otherwise(F.lit(0))
    return F.when(kinds > 0, (hits - least) / F.array_max(sizes))
