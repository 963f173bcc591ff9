"""Any set of descriptor blocks from one read of the strings.

Most blocks look at letters or at pairs of letters that stand a lag apart, and are linear in how often each occurs.  A task
lays the strings of a batch end to end and counts the letters, and the pairs of each lag, once; shares, transitions,
correlations and order couplings are products of these counts with fixed matrices.  A block's features are known
beforehand, so a cell is a place in the block and a number, names are looked up only for those who want them, and
joining the blocks of a string means writing its cells side by side: nothing is shuffled.

A block has cells only for places that exist: none where a string is too short, null where a value is undefined.  Zero
cells are left out.  Letters outside the alphabet count for the length and for nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.operators.composition import Strings, letter_code, lists, pairs_in_order, per_string
from seqloom.sources.tables import block_name

#: Strings that are laid together, and those whose full rows are handed over together.
ROWS, DENSE_ROWS = 1024, 64
A = L.LETTERS
N = len(A)
NUMBER = np.full(256, -1)
NUMBER[[letter_code(a) for a in A]] = np.arange(N)


@dataclass(frozen=True)
class Parameters:
    """Tables that the blocks are made with; any can be the caller's own (`sources.tables.lookup_rows`)."""

    properties: dict = field(default_factory=L.property_rows)
    matrix: dict = field(default_factory=L.similarity_scores)
    distances: dict = field(default_factory=L.grantham)
    classes: dict = field(default_factory=lambda: L.THREE_CLASSES)
    pair_gaps: int = 4
    group_gaps: int = 10
    triad_gaps: int = 1
    correlation_lags: int = 4
    product_lags: int = 5
    covariance_lags: int = 3
    coupling_lags: int = 5
    order_lags: int = 3
    weight: float = 0.05
    window: int = 4
    group_window: int = 3


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A value for each letter pair, in the order of the pair counts."""
    return np.multiply.outer(x, y).ravel()


def row_values(row: dict[str, float]) -> np.ndarray:
    return np.array([float(row[a]) for a in A])


def over(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows over their number of places; nothing where there is none."""
    n = np.asarray(n, float)[:, None]
    return np.divide(x, n, out=np.zeros(np.broadcast_shapes(x.shape, n.shape)), where=n > 0)


class Tally:
    """Strings of a batch and what several blocks count in them, counted when first asked for.

    With ``few``, blocks ask for some of their cells only, and sums over pairs are made without a count of every pair.
    """

    def __init__(self, texts: Strings, p: Parameters, few: bool = False):
        self.s, self.n, self.p, self.few = texts, texts.n, p, few
        self.number = NUMBER[np.clip(texts.codes, 0, 255)]
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._pairs: dict[int, np.ndarray] = {}

    def counted(self, row: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(row * size + code, minlength=len(self.n) * size).reshape(-1, size).astype(float)

    @cached_property
    def letters(self) -> np.ndarray:
        known = self.number >= 0
        return self.counted(self.s.row[known], self.number[known], N)

    def pairs_at(self, lag: int) -> tuple[np.ndarray, np.ndarray]:
        """String and number of every letter pair."""
        if lag not in self._at:
            at = self.s.neighbours(lag)
            a, b = self.number[at], self.number[at + lag]
            known = (a >= 0) & (b >= 0)
            self._at[lag] = self.s.row[at[known]], a[known] * N + b[known]
        return self._at[lag]

    def pairs(self, lag: int) -> np.ndarray:
        if lag not in self._pairs:
            self._pairs[lag] = self.counted(*self.pairs_at(lag), N * N)
        return self._pairs[lag]

    def some_pairs(self, lag: int, column: np.ndarray) -> np.ndarray:
        """Counts by column of the pairs whose ``column`` is not negative."""
        row, code = self.pairs_at(lag)
        at = column[code]
        kept = at >= 0
        return self.counted(row[kept], at[kept], column.max() + 1)

    def pair_sum(self, lag: int, values: np.ndarray) -> np.ndarray:
        """Per string the sum of the values of its pairs."""
        if not self.few:
            return self.pairs(lag) @ values
        row, code = self.pairs_at(lag)
        return np.bincount(row, values[code], len(self.n))

    def group_triples(self, groups: dict[str, str], step: int) -> np.ndarray:
        return self.counted(*self.triples_at(groups, step), len(groups) ** 3)

    def triples_at(self, groups: dict[str, str], step: int) -> tuple[np.ndarray, np.ndarray]:
        """String and number of every triple of groups."""
        size = len(groups)
        of = np.full(N + 1, -1)
        for i, members in enumerate(groups.values()):
            of[[A.index(a) for a in members]] = i
        own = of[self.number]
        at = self.s.neighbours(step, 3)
        a, b, c = own[at], own[at + step], own[at + 2 * step]
        known = (a >= 0) & (b >= 0) & (c >= 0)
        return self.s.row[at[known]], ((a * size + b) * size + c)[known]

    @cached_property
    def ends(self) -> Tally:
        """The first letter and the last five of every string."""
        s = self.s
        keep = np.flatnonzero(s.place >= (s.n - 5)[s.row])
        at = np.concatenate([s.begin[s.n > 0], keep])
        at = at[np.argsort(np.concatenate([2 * s.row[s.begin[s.n > 0]], 2 * s.row[keep] + 1]), kind="stable")]
        return Tally(Strings.of(s.codes[at], np.bincount(s.row[at], minlength=len(s.n))), self.p)


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def full(m: np.ndarray) -> Cells:
    """(string, place, value) of the cells that are not zero."""
    row, place = np.nonzero(m)
    return row, place, m[row, place]


def columns_of(places: np.ndarray, size: int) -> np.ndarray:
    """The column of each of ``size`` places, -1 where it is not asked for."""
    out = np.full(size, -1)
    out[places] = np.arange(len(places))
    return out


@dataclass(frozen=True)
class Block:
    name: str
    features: list[str]
    cells: Callable[[Tally], Cells]
    #: Strings by some places (ascending): the values that ``cells`` gives there, without the other cells.
    some: Callable[[Tally, np.ndarray], np.ndarray] | None = None

    def values(self, t: Tally, places: np.ndarray) -> np.ndarray:
        if self.some is not None:
            return self.some(t, places)
        column = columns_of(places, len(self.features))
        row, place, value = self.cells(t)
        at = column[place]
        out = np.zeros((len(t.n), len(places)))
        out[row[at >= 0], at[at >= 0]] = value[at >= 0]
        return out


def _group_matrix(groups: dict[str, str]) -> np.ndarray:
    m = np.zeros((N, len(groups)))
    for i, members in enumerate(groups.values()):
        m[[A.index(a) for a in members], i] = 1
    return m


FIVE = list(L.FIVE_GROUPS)
SEVEN = list(L.SEVEN_GROUPS)
LETTER_GROUPS = _group_matrix(L.FIVE_GROUPS)
PAIR_GROUPS = np.einsum("ax,by->abxy", LETTER_GROUPS, LETTER_GROUPS).reshape(N * N, -1)
PAIRS = [a + b for a in A for b in A]
GROUP_PAIRS = [f"{a}.{b}" for a in FIVE for b in FIVE]


def _triples(t: Tally) -> Cells:
    at = t.s.neighbours(1, 3)
    a, b, c = t.number[at], t.number[at + 1], t.number[at + 2]
    known = (a >= 0) & (b >= 0) & (c >= 0)
    cell, n = np.unique((t.s.row[at] * N**3 + (a * N + b) * N + c)[known], return_counts=True)
    row, place = np.divmod(cell, N**3)
    return row, place, n / (t.n[row] - 2)


def _expectation(t: Tally) -> Cells:
    codons = row_values(L.CODONS) / 61
    expected = outer(codons, codons)
    places = np.maximum(t.n - 1, 0)
    spread = np.sqrt(over(np.tile(expected * (1 - expected), (len(t.n), 1)), places))
    off = over(t.pairs(1), places) - expected
    return full(np.divide(off, spread, out=np.zeros_like(off), where=(places > 0)[:, None]))


def _some_expectations(t: Tally, places: np.ndarray) -> np.ndarray:
    codons = row_values(L.CODONS) / 61
    expected = outer(codons, codons)[places]
    n = np.maximum(t.n - 1, 0)
    spread = np.sqrt(over(np.tile(expected * (1 - expected), (len(t.n), 1)), n))
    off = over(t.some_pairs(1, columns_of(places, N * N)), n) - expected
    return np.divide(off, spread, out=np.zeros_like(off), where=(n > 0)[:, None])


class Lagged:
    """Sums over neighbours of two properties' values."""

    def __init__(self, t: Tally, rows: dict):
        self.t, self.values = t, [row_values(r) for r in rows.values()]
        self.mean = [over(t.letters @ v[:, None], t.n)[:, 0] for v in self.values]
        self.spread = [t.letters @ (v * v) - t.n * m * m for v, m in zip(self.values, self.mean)]

    def centred(self, i: int, j: int, lag: int) -> np.ndarray:
        """The mean of the products of the deviations of the first's and the second's value."""
        x, y, one = self.values[i], self.values[j], np.ones(N)
        pairs, places = self.t.pairs(lag), np.maximum(self.t.n - lag, 0)
        total = pairs @ outer(x, y) - self.mean[j] * (pairs @ outer(x, one)) - self.mean[i] * (pairs @ outer(one, y))
        return over((total + places * self.mean[i] * self.mean[j])[:, None], places)[:, 0]

    def unless_flat(self, top: np.ndarray, bottom: np.ndarray, i: int, there: np.ndarray) -> np.ndarray:
        varies = self.spread[i] > 1e-9
        out = np.divide(top, bottom, out=np.full(len(top), np.nan), where=varies)
        return np.where(there, out, 0.0)


def _by_lag(lags: int, rows: dict, one: Callable) -> Callable[[Tally], Cells]:
    def cells(t: Tally) -> Cells:
        sums = Lagged(t, rows)
        return full(np.stack([one(t, sums, i, lag) for i in range(len(rows)) for lag in range(1, lags + 1)], 1))

    return cells


def _moran(t: Tally, s: Lagged, i: int, lag: int) -> np.ndarray:
    return s.unless_flat(s.centred(i, i, lag) * t.n, s.spread[i], i, t.n > lag)


def _geary(lags: int):
    def one(t: Tally, s: Lagged, i: int, lag: int) -> np.ndarray:
        x = s.values[i]
        gaps = t.pairs(lag) @ (np.subtract.outer(x, x).ravel() ** 2)
        found = s.unless_flat((t.n - 1) * gaps, 2 * np.maximum(t.n - lag, 1) * s.spread[i], i, t.n > lag)
        return np.where((t.n > lag) & (t.n <= lags), np.nan, found)

    return one


def _product(t: Tally, s: Lagged, i: int, lag: int) -> np.ndarray:
    return over((t.pairs(lag) @ outer(s.values[i], s.values[i]))[:, None], np.maximum(t.n - lag, 0))[:, 0]


def _covariances(rows: dict, lags: int, pairs: Sequence[tuple[int, int]]):
    def cells(t: Tally) -> Cells:
        sums = Lagged(t, rows)
        return full(np.stack([sums.centred(i, j, lag) for i, j in pairs for lag in range(1, lags + 1)], 1))

    return cells


def _class_pairs(classes: Sequence[str]) -> np.ndarray:
    """Which letter pairs change between two of three classes, in either order."""
    own = _group_matrix(dict(enumerate(classes)))
    both = [np.multiply.outer(own[:, i], own[:, j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.stack([(m + m.T).ravel() for m in both], 1)


SHARES = {"residue0": 0.0, "residue25": 0.25, "residue50": 0.5, "residue75": 0.75, "residue100": 1.0}


def _distribution(classes: dict) -> Callable[[Tally, np.ndarray], np.ndarray]:
    """Strings by places, ascending: the relative place of the share of a class's letters."""
    every, shares = [m for three in classes.values() for m in three], list(SHARES.values())

    def some(t: Tally, places: np.ndarray) -> np.ndarray:
        out = []
        for group in np.unique(places // len(shares)):
            there = np.zeros(N + 1, bool)
            there[[A.index(a) for a in every[group]]] = True
            at = np.flatnonzero(there[t.number])
            n = np.bincount(t.s.row[at], minlength=len(t.n))
            first = np.cumsum(n) - n
            for share in (shares[p % len(shares)] for p in places if p // len(shares) == group):
                nth = first + np.maximum(1, np.floor(share * n).astype(np.int64)) - 1
                place = t.s.place[at[np.minimum(nth, max(0, len(at) - 1))]] + 1 if len(at) else np.zeros(len(t.n))
                out.append(np.where(n > 0, place * 100.0 / np.maximum(t.n, 1), 0.0))
        return np.stack(out, 1)

    return some


def _triads(gaps: Sequence[int]) -> Callable[[Tally], Cells]:
    def cells(t: Tally) -> Cells:
        parts = []
        for gap in gaps:
            n = t.group_triples(L.SEVEN_GROUPS, gap + 1)
            parts.append(over(n - n.min(1, keepdims=True), n.max(1)))
        return full(np.hstack(parts))

    return cells


def _some_triads(t: Tally, places: np.ndarray) -> np.ndarray:
    size, out = len(SEVEN) ** 3, []
    for gap in np.unique(places // size):
        own = places[places // size == gap] % size
        row, code = t.triples_at(L.SEVEN_GROUPS, int(gap) + 1)
        cell, n = np.unique(row * size + code, return_counts=True)
        which = cell // size
        begin = np.flatnonzero(np.diff(which, prepend=-1))
        least, most = np.zeros(len(t.n)), np.zeros(len(t.n))
        if len(cell):
            most[which[begin]] = np.maximum.reduceat(n, begin)
            # the least is that of the triples that are not there, unless all are
            least[which[begin]] = np.where(np.diff(begin, append=len(cell)) == size, np.minimum.reduceat(n, begin), 0)
        at = columns_of(own, size)[code]
        out.append(over(t.counted(row[at >= 0], at[at >= 0], len(own)) - least[:, None], most))
    return np.hstack(out)


def _coupled(t: Tally, lag: int) -> np.ndarray:
    squares = np.array([float(t.p.distances[a, b]) ** 2 for a in A for b in A])
    return t.pair_sum(lag, squares)


def _couplings(lags: int) -> Callable[[Tally], Cells]:
    return lambda t: full(np.stack([over(_coupled(t, d)[:, None], np.maximum(t.n - d, 0))[:, 0] for d in range(1, lags + 1)], 1))


def _sequence_order(lags: int, weight: float) -> Callable[[Tally], Cells]:
    def cells(t: Tally) -> Cells:
        totals = np.stack([_coupled(t, d) for d in range(1, lags + 1)], 1)
        return full(over(np.hstack([t.letters, weight * totals]), 1 + weight * totals.sum(1)))

    return cells


def _pseudo(thetas: Callable[[Tally], np.ndarray], weight: float) -> Callable[[Tally], Cells]:
    """Letter counts and weighted thetas (strings by thetas) over 1 + the weighted thetas."""

    def cells(t: Tally) -> Cells:
        theta = weight * over(thetas(t), np.maximum(t.n - 1, 0))
        return full(over(np.hstack([t.letters, theta]), 1 + theta.sum(1)) * (t.n > 1)[:, None])

    return cells


def _ordered(t: Tally) -> Cells:
    m = np.zeros((len(t.n), N * N))
    for i in np.flatnonzero(t.n > 1):
        m[i] = pairs_in_order(t.s, i).ravel() / (t.n[i] * (t.n[i] - 1) / 2)
    return full(m)


def _some_ordered(t: Tally, places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(t.n), len(places)))
    for column, (a, b) in enumerate(zip(*np.divmod(places, N))):
        first, at = t.number == a, np.flatnonzero(t.number == b)
        before = np.append(0, np.cumsum(first))  # first letters before each place, from the first string on
        found = np.bincount(t.s.row[at], before[at] - before[t.s.begin[t.s.row[at]]], len(t.n))
        out[:, column] = np.divide(found, t.n * (t.n - 1) / 2, out=np.zeros(len(t.n)), where=t.n > 1)
    return out


def _windows(width: int, of: np.ndarray) -> Callable[[Tally], Cells]:
    """Shares in every window of the ends; ``of`` gives each letter's columns."""

    def cells(t: Tally) -> Cells:
        e, count = t.ends, 7 - width
        m = np.zeros((len(e.n), count, of.shape[1]))
        known = e.number >= 0
        for first in range(count):
            inside = known & (e.s.place >= first) & (e.s.place < first + width) & (e.n >= first + width)[e.s.row]
            np.add.at(m[:, first], e.s.row[inside], of[e.number[inside]] / width)
        return full(m.reshape(len(e.n), -1))

    return cells


def _positions(of: np.ndarray) -> Callable[[Tally], Cells]:
    """Values of the letter at each of the six places of the ends."""

    def cells(t: Tally) -> Cells:
        e = t.ends
        m = np.zeros((len(e.n), 6, of.shape[1]))
        known = e.number >= 0
        m[e.s.row[known], e.s.place[known]] = of[e.number[known]]
        return full(m.reshape(len(e.n), -1))

    return cells


def _charge(letters: np.ndarray, ph: float = 7.4) -> np.ndarray:
    total = np.zeros(len(letters))
    for sign, pks in ((1, L.PK_POSITIVE), (-1, L.PK_NEGATIVE)):
        for name, pk in pks.items():
            n = letters[:, A.index(name)] if len(name) == 1 else 1.0
            total += sign * n / (1 + 10.0 ** (sign * (ph - pk)))
    return total


def _physical(t: Tally) -> Cells:
    total = lambda row: t.letters @ row_values(row)
    columns = [
        t.n, over(t.letters @ _group_matrix({"": "FYW"}), t.n)[:, 0], over(total(L.hydropathy())[:, None], t.n)[:, 0],
        _charge(t.letters), total(L.residue_masses()) + L.WATER_MASS,
    ]
    return full(np.stack(columns, 1) * (t.n > 0)[:, None])


def _all(p: Parameters) -> list[Block]:
    std = {k: L.standardized(r) for k, r in p.properties.items()}
    props, two = list(std), list(std)[:2]
    several = range(len(props))
    lagged = lambda name, n: [f"{name}_{q}.lag{d}" for q in props for d in range(1, n + 1)]
    own = [(i, i) for i in several]
    cross = [(i, j) for i in several for j in several if i != j]
    crossed = lambda name, pairs: [f"{name}_{props[i]}.{props[j]}.lag{d}" for i, j in pairs for d in range(1, p.covariance_lags + 1)]
    classed = [f"{c}.G{i}" for c in p.classes for i in (1, 2, 3)]
    class_matrix = np.hstack([_group_matrix(dict(enumerate(c))) for c in p.classes.values()])
    changes = np.hstack([_class_pairs(c) for c in p.classes.values()])
    z = {f"z{i + 1}": {a: v[i] for a, v in L.ZSCALES.items()} for i in range(5)}
    places = lambda name, columns: [f"{name}_p{i}.{c}" for i in range(1, 7) for c in columns]
    columns = lambda rows: np.stack([row_values(r) for r in rows], 1)
    matrix = np.array([[float(p.matrix[a, b]) for b in A] for a in A])

    def pseudo_theta(t: Tally) -> np.ndarray:
        squares = sum(np.subtract.outer(v, v).ravel() ** 2 for v in map(row_values, std.values())) / len(std)
        return t.pair_sum(1, squares)[:, None]

    def amphi_theta(t: Tally) -> np.ndarray:
        return np.stack([t.pair_sum(1, outer(v, v)) for v in (row_values(std[q]) for q in two)], 1)

    def gapped(gaps: int, of: np.ndarray | None) -> Callable[[Tally], Cells]:
        def cells(t: Tally) -> Cells:
            parts = [over(t.pairs(g + 1) if of is None else t.pairs(g + 1) @ of, np.maximum(t.n - g - 1, 0)) for g in range(gaps + 1)]
            return full(np.hstack(parts))

        return cells

    def some_gapped(of: np.ndarray, size: int) -> Callable[[Tally, np.ndarray], np.ndarray]:
        """``of`` gives the number of each letter pair among the ``size`` places of a gap."""

        def some(t: Tally, places: np.ndarray) -> np.ndarray:
            parts = []
            for g in np.unique(places // size):
                column = columns_of(places[places // size == g] % size, size)[of]
                parts.append(over(t.some_pairs(int(g) + 1, column), np.maximum(t.n - g - 1, 0)))
            return np.hstack(parts)

        return some

    some_pairs, some_groups = some_gapped(np.arange(N * N), N * N), some_gapped(PAIR_GROUPS.argmax(1), len(GROUP_PAIRS))
    distribution = _distribution(p.classes)
    distributed = [f"CTDD_{c}.{i}.{r}" for c in p.classes for i in (1, 2, 3) for r in SHARES]

    return [
        Block("AAC", [f"AAC_{a}" for a in A], lambda t: full(over(t.letters, t.n))),
        Block("CKSAAP", [f"CKSAAP_{ab}.gap{g}" for g in range(p.pair_gaps + 1) for ab in PAIRS], gapped(p.pair_gaps, None), some_pairs),
        Block("TPC", [f"TPC_{ab}{c}" for ab in PAIRS for c in A], _triples),
        Block("DPC", [f"DPC_{ab}" for ab in PAIRS], gapped(0, None), some_pairs),
        Block("DDE", [f"DDE_{ab}" for ab in PAIRS], _expectation, _some_expectations),
        Block("GAAC", [f"GAAC_{g}" for g in FIVE], lambda t: full(over(t.letters @ LETTER_GROUPS, t.n))),
        Block("CKSAAGP", [f"CKSAAGP_{ab}.gap{g}" for g in range(p.group_gaps + 1) for ab in GROUP_PAIRS], gapped(p.group_gaps, PAIR_GROUPS),
              some_groups),
        Block("GDPC", [f"GDPC_{ab}" for ab in GROUP_PAIRS], gapped(0, PAIR_GROUPS), some_groups),
        Block("GTPC", [f"GTPC_{ab}.{c}" for ab in GROUP_PAIRS for c in FIVE],
              lambda t: full(over(t.group_triples(L.FIVE_GROUPS, 1), np.maximum(t.n - 2, 0)))),
        Block("Moran", lagged("Moran", p.correlation_lags), _by_lag(p.correlation_lags, std, _moran)),
        Block("Geary", lagged("Geary", p.correlation_lags), _by_lag(p.correlation_lags, std, _geary(p.correlation_lags))),
        Block("NMBroto", lagged("NMBroto", p.product_lags), _by_lag(p.product_lags, std, _product)),
        Block("CTDC", [f"CTDC_{c}" for c in classed], lambda t: full(over(t.letters @ class_matrix, t.n))),
        Block("CTDT", [f"CTDT_{c}.Tr{x}" for c in p.classes for x in ("1221", "1331", "2332")],
              lambda t: full(over(t.pairs(1) @ changes, np.maximum(t.n - 1, 0)))),
        Block("CTDD", distributed, lambda t: full(distribution(t, np.arange(len(distributed)))), distribution),
        Block("CTriad", [f"CTriad_{a}.{b}.{c}" for a in SEVEN for b in SEVEN for c in SEVEN], _triads([0]), _some_triads),
        Block("KSCTriad", [f"KSCTriad_{a}.{b}.{c}.gap{g}" for g in range(p.triad_gaps + 1) for a in SEVEN for b in SEVEN for c in SEVEN],
              _triads(range(p.triad_gaps + 1)), _some_triads),
        Block("SOCNumber", [f"SOCNumber_gGrantham.lag{d}" for d in range(1, p.coupling_lags + 1)], _couplings(p.coupling_lags)),
        Block("QSOrder", [f"QSOrder_Grantham.Xr.{a}" for a in A] + [f"QSOrder_Grantham.Xd.{d}" for d in range(1, p.order_lags + 1)],
              _sequence_order(p.order_lags, p.weight)),
        Block("PAAC", [f"PAAC_Xc1.{a}" for a in A] + ["PAAC_Xc2.lambda1"], _pseudo(pseudo_theta, p.weight)),
        Block("APAAC", [f"APAAC_Pc1.{a}" for a in A] + [f"APAAC_Pc2.{q}.1" for q in two], _pseudo(amphi_theta, p.weight)),
        Block("ASDC", [f"ASDC_{ab}" for ab in PAIRS], _ordered, _some_ordered),
        Block("AC", lagged("AC", p.covariance_lags), _covariances(std, p.covariance_lags, own)),
        Block("CC", crossed("CC", cross), _covariances(std, p.covariance_lags, cross)),
        Block("ACC", crossed("ACC", own + cross), _covariances(std, p.covariance_lags, own + cross)),
        Block("EAAC", [f"EAAC_SW.{i}.{a}" for i in range(1, 8 - p.window) for a in A], _windows(p.window, np.eye(N))),
        Block("EGAAC", [f"EGAAC_SW.{i}.{g}" for i in range(1, 8 - p.group_window) for g in FIVE], _windows(p.group_window, LETTER_GROUPS)),
        Block("AAIndex", places("AAIndex", props), _positions(columns(p.properties.values()))),
        Block("BLOSUM62", places("BLOSUM62", A), _positions(matrix)),
        Block("ZScale", places("ZScale", z), _positions(columns(z.values()))),
        Block("Physicochemical", ["Length", "Aromaticity", "Hydrophobicity", "NetC", "MW"], _physical),
    ]


@cache
def _defaults() -> dict[str, Block]:
    return {b.name: b for b in _all(Parameters())}


def descriptors(p: Parameters | None = None) -> dict[str, Block]:
    """All blocks by name."""
    return _defaults() if p is None else {b.name: b for b in _all(p)}


NAMES = tuple(_defaults())


def descriptor(name: str, p: Parameters | None = None) -> Block:
    """A block by the descriptor's name, of which what follows the first space does not count."""
    known = descriptors(p)
    if block_name(name) not in known:
        raise ValueError(f"unknown descriptor {name}; expected one of {list(known)}")
    return known[block_name(name)]


def dictionary(spark: SparkSession, names: Sequence[str] = NAMES, p: Parameters | None = None) -> DataFrame:
    """(block, place, at, feature): the features of the blocks, their place in the block and in the joined row."""
    rows, at = [], 0
    for block in (descriptor(n, p) for n in names):
        rows += [(block.name, i, at + i, f) for i, f in enumerate(block.features)]
        at += len(block.features)
    return spark.createDataFrame(rows, "block string, place int, at int, feature string")


def _lists(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    which, sizes = np.unique(row, return_counts=True)
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    values = pa.array(value.astype(np.float64), pa.float64(), from_pandas=True)  # not a number: null
    return which, [lists(place, sizes, pa.int32()), pa.ListArray.from_arrays(ends, values)]


def block_cells(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", names: Sequence[str] = NAMES, p: Parameters | None = None
) -> DataFrame:
    """(keys, block, places, values): the cells of every string, one row for each block that has any.

    The strings are read once, whatever the number of blocks; a null string has no cells.
    """
    blocks, own = [descriptor(n, p) for n in names], p or Parameters()

    def run(s: Strings):
        t = Tally(s, own)
        for block in blocks:
            which, columns = _lists(*block.cells(t))
            if len(which):
                yield which, [pa.array([block.name] * len(which)), *columns]

    return per_string(df, keys, seq, "block string, places array<int>, values array<double>", run, ROWS)


def _joined(t: Tally, blocks: list[Block]) -> Cells:
    parts, at = [], 0
    for block in blocks:
        row, place, value = block.cells(t)
        parts.append((row, place + at, value))
        at += len(block.features)
    row, place, value = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, row))
    return row[order], place[order], value[order]


def joined_cells(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", names: Sequence[str] = NAMES, p: Parameters | None = None
) -> DataFrame:
    """(keys, places, values): the cells of all blocks of a string in one row; places are `dictionary`'s ``at``.

    Strings without a cell have no row.
    """
    blocks, own = [descriptor(n, p) for n in names], p or Parameters()

    def run(s: Strings):
        yield _lists(*_joined(Tally(s, own), blocks))

    return per_string(df, keys, seq, "places array<int>, values array<double>", run, ROWS)


def dense_blocks(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", names: Sequence[str] = NAMES, p: Parameters | None = None
) -> DataFrame:
    """(keys, features): the joined row in full, zero where there is no cell, null where a value is undefined."""
    blocks, own = [descriptor(n, p) for n in names], p or Parameters()
    width = sum(len(b.features) for b in blocks)

    def run(s: Strings):
        row, place, value = _joined(Tally(s, own), blocks)
        for start in range(0, len(s.n), DENSE_ROWS):
            which = np.arange(start, min(start + DENSE_ROWS, len(s.n)))
            which = which[s.n[which] > 0]
            if not len(which):
                continue
            first, last = np.searchsorted(row, [which[0], which[-1] + 1])
            m = np.zeros((len(which), width))
            m[np.searchsorted(which, row[first:last]), place[first:last]] = value[first:last]
            ends = pa.array(np.arange(len(which) + 1, dtype=np.int32) * width)
            yield which, [pa.ListArray.from_arrays(ends, pa.array(m.ravel(), pa.float64(), from_pandas=True))]

    return per_string(df, keys, seq, "features array<double>", run, ROWS)


#: Blocks that have a value, if only zero, for strings of any length.
ANY_LENGTH = frozenset({"CTDD", "CKSAAP", "CKSAAGP", "QSOrder"})


def least_length(block: str, feature: str) -> int:
    """The shortest string that has the feature."""
    if block in ANY_LENGTH:
        return 0
    if block == "KSCTriad":
        return 2 * int(feature.rpartition(".gap")[2]) + 3
    return {"DDE": 2, "ASDC": 2, "PAAC": 2, "APAAC": 2, "DPC": 2, "GDPC": 2, "CTDT": 2, "TPC": 3, "GTPC": 3, "CTriad": 3}.get(block, 1)


def named_features(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], seq: str = "seq", out: str = "features", p: Parameters | None = None
) -> DataFrame:
    """(keys, out): the named features of every string as an array, null where a string is too short or a value undefined.

    The blocks they belong to are counted in one pass over the strings.
    """
    own, where = p or Parameters(), {}
    for block in descriptors(p).values():
        where |= {f: (block, i) for i, f in enumerate(block.features)}
    places = [where[f] for f in features]
    least = np.array([least_length(b.name, f) for (b, _), f in zip(places, features)])
    blocks = {b.name: b for b, _ in places}
    #: Of each block the places, ascending, and for every feature which of them it is.
    asked = {n: np.unique([i for b, i in places if b.name == n], return_inverse=True) for n in blocks}
    columns = {n: [c for c, (b, _) in enumerate(places) if b.name == n] for n in blocks}

    def run(s: Strings):
        t = Tally(s, own, few=True)
        m = np.zeros((len(s.n), len(places)))
        for name, block in blocks.items():
            m[:, columns[name]] = block.values(t, asked[name][0])[:, asked[name][1]]
        m[s.n[:, None] < least] = np.nan
        ends = pa.array(np.arange(len(s.n) + 1, dtype=np.int32) * len(places))
        yield np.arange(len(s.n)), [pa.ListArray.from_arrays(ends, pa.array(m.ravel(), pa.float64(), from_pandas=True))]

    return per_string(df, keys, seq, f"{out} array<double>", run, ROWS)


def long_cells(cells: DataFrame, keys: Sequence[str], names: DataFrame) -> DataFrame:
    """(keys, block, feature, value), one row per cell; ``names`` is the `dictionary`, whose size the blocks fix."""
    rows = cells.select(*keys, "block", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("values").alias("value"))))
    return rows.join(F.broadcast(names.select("block", "place", "feature")), ["block", "place"]).select(*keys, "block", "feature", "value")


class BlockStore:
    """Blocks on disk: a folder per block, and in it the rows in buckets of their keys.

    Blocks that are read together are joined bucket by bucket, without an exchange.
    """

    def __init__(self, spark: SparkSession, table: str, keys: Sequence[str]):
        self.spark, self.table, self.keys = spark, table, list(keys)

    @classmethod
    def write(cls, cells: DataFrame, path: str, table: str, keys: Sequence[str], buckets: int) -> BlockStore:
        """Write `block_cells` below ``path``, as the table ``table`` of the session's catalog."""
        dealt = cells.repartition(buckets, *keys)  # one file for each bucket and block
        dealt.write.option("path", path).partitionBy("block").bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
        return cls(cells.sparkSession, table, keys)

    @classmethod
    def open(cls, spark: SparkSession, path: str, table: str, keys: Sequence[str], buckets: int) -> BlockStore:
        """A store that another session has written."""
        kinds = spark.read.parquet(path).drop("block").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {table} ({columns}, block string) USING parquet PARTITIONED BY (block) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {table}")
        return cls(spark, table, keys)

    def block(self, name: str) -> DataFrame:
        """The cells of one block; only its folder is read."""
        return self.spark.table(self.table).filter(F.col("block") == block_name(name))

    def joined(self, names: Sequence[str], p: Parameters | None = None) -> DataFrame:
        """(keys, places, values) of the strings that have cells in all the named blocks; as `joined_cells`."""
        out, at = None, 0
        for i, name in enumerate(names):
            part = self.block(name).select(
                *self.keys, F.transform("places", lambda x: x + at).alias(f"_p{i}"), F.col("values").alias(f"_v{i}")
            )
            out = part if out is None else out.join(part.hint("merge"), self.keys)
            at += len(descriptor(name, p).features)
        each = range(len(names))
        return out.select(
            *self.keys, F.concat(*[F.col(f"_p{i}") for i in each]).alias("places"), F.concat(*[F.col(f"_v{i}") for i in each]).alias("values")
        )
