"""Strings of an Arrow batch as one run of bytes: sums and comparisons by place, without a loop over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are looked at in one array; a batch of longer strings is cut into pieces.
LETTERS_AT_ONCE = 1 << 20


def pieces(*texts: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The rows in order, as many at a time as have ``LETTERS_AT_ONCE`` bytes, but one at least."""
    ends = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(t), 0), dtype="int64") for t in texts))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + LETTERS_AT_ONCE, side="right")))
        yield tuple(t.slice(start, stop - start) for t in texts)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins, with the end of the last; a null has none."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = "int64" if pa.types.is_large_string(texts.type) else "int32"
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    letters = np.frombuffer(data, "uint8") if data is not None else np.empty(0, "uint8")
    return letters[bounds[0] : bounds[-1]], bounds - bounds[0]


def joined(results: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(results) if results else pa.array([], kind)


def by_pieces(function: Callable[..., pa.Array], kind: pa.DataType, *texts: pa.Array) -> pa.Array:
    return joined([function(*part) for part in pieces(*texts)], kind)


def table_of(codes: list[float]) -> np.ndarray:
    """For every byte what ``element_at(codes, byte - 64)`` gives, -1 where that is an error."""
    out = np.full(256, -1, "int64")
    for byte in range(128):
        i = byte - 64
        if 1 <= i <= len(codes) or -len(codes) <= i <= -1:
            out[byte] = int(codes[i - 1 if i > 0 else len(codes) + i])
    return out


def pair_sum(first: pa.Array, second: pa.Array, codes: np.ndarray, cells: np.ndarray) -> pa.Array:
    """Per row the sum, in order, of the cells of the letters at the same place; null for unequal lengths or a null."""
    (a, at), (b, bt) = flat(first), flat(second)
    known = codes >= 0
    if not (known[a].all() and known[b].all()):
        raise ValueError("a string has a character that is no letter A to Z")
    n, m = np.diff(at), np.diff(bt)
    missing = np.asarray(pc.or_(pc.is_null(first), pc.is_null(second))) | (n != m)
    row = np.repeat(np.arange(len(n)), n)
    if missing.any():
        kept = ~missing
        a, b = a[kept[row]], b[np.repeat(kept, m)]
        row = row[kept[row]]
    pairs = np.zeros((256, 256))  # the cell of every pair of bytes
    pairs[np.ix_(known, known)] = cells.reshape(20, 20)[np.ix_(codes[known], codes[known])]
    total = np.bincount(row, pairs.ravel()[(a.astype("uint16") << 8) | b], len(n)).astype("float64")
    return pa.array(total, mask=missing)


def differing(first: pa.Array, second: pa.Array) -> pa.Array:
    """Per row how many places differ, over the shorter length; null beside a string that has letters."""
    (a, at), (b, bt) = flat(first), flat(second)
    n, m = np.diff(at), np.diff(bt)
    if (a > 127).any() or (b > 127).any():
        pairs = zip(pc.fill_null(first, "").to_pylist(), pc.fill_null(second, "").to_pylist())
        found = np.fromiter((sum(x != y for x, y in zip(s, t)) for s, t in pairs), "int32", len(n))
    elif (n == m).all():
        found = np.bincount(np.repeat(np.arange(len(n)), n)[a != b], minlength=len(n)).astype("int32")
    else:
        shorter = np.minimum(n, m)
        row = np.repeat(np.arange(len(n)), shorter)
        place = np.arange(len(row)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
        unlike = a[at[row] + place] != b[bt[row] + place]
        found = np.bincount(row[unlike], minlength=len(n)).astype("int32")
    none, other = np.asarray(pc.is_null(first)), np.asarray(pc.is_null(second))
    return pa.array(found, mask=(none & (m > 0)) | (other & (n > 0)))


def letter_total(texts: pa.Array, contribution: dict[str, float], constant: float) -> pa.Array:
    """Per row a constant plus count times value of each letter, added in the order of ``contribution``."""
    letters, at = flat(texts)
    values = {letter: float(value) for letter, value in contribution.items() if value}
    cell = np.full(256, len(values))  # the last is for all other letters
    for i, letter in enumerate(values):
        cell[ord(letter)] = i
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    # letters x rows: the sum then runs along whole rows
    counts = np.bincount((cell * len(texts))[letters] + row, minlength=(len(values) + 1) * len(texts)).reshape(-1, len(texts))
    total = np.full(len(texts), float(constant))
    for i, value in enumerate(values.values()):
        total += counts[i] * value
    return pa.array(total, mask=np.asarray(pc.is_null(texts)))


def count_in(texts: pa.Array, members: str) -> np.ndarray:
    """Per row how many bytes are among ``members``, which are ASCII."""
    letters, at = flat(texts)
    counted = np.zeros(256, bool)
    counted[list(members.encode("ascii"))] = True
    return np.bincount(np.repeat(np.arange(len(texts)), np.diff(at))[counted[letters]], minlength=len(texts))


def single_variants(texts: pa.Array, alphabet: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, place from 0, number of the letter, string) of all strings one replacement away, by row, place and letter.

    The new strings are cut where they have ``LETTERS_AT_ONCE`` bytes, but not within a place.
    """
    if not len(texts):
        return
    if not pc.all(pc.string_is_ascii(pc.fill_null(texts, ""))).as_py():
        yield from _single_variants_of_characters(texts, alphabet)
        return
    letters, at = flat(texts)
    n, new = np.diff(at), np.frombuffer(alphabet.encode("ascii"), "uint8")
    row = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n[row] * len(new))
    start = 0
    while start < len(row):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + LETTERS_AT_ONCE, side="right")))
        place, letter = np.nonzero(letters[start:stop, None] != new)
        place += start
        own = row[place]
        sizes, place = n[own], place - at[own]
        bounds = np.append(0, np.cumsum(sizes))
        out = letters[np.repeat(at[own] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        out[bounds[:-1] + place] = new[letter]
        yield own, place, letter, pa.StringArray.from_buffers(len(own), pa.py_buffer(bounds.astype("int32")), pa.py_buffer(out))
        start = stop


def _single_variants_of_characters(texts: pa.Array, alphabet: str):
    for row, text in enumerate(texts.to_pylist()):
        for place, old in enumerate(text or ""):
            letter = [i for i, x in enumerate(alphabet) if x != old]
            new = [text[:place] + alphabet[i] + text[place + 1 :] for i in letter]
            yield np.full(len(new), row), np.full(len(new), place), np.array(letter), pa.array(new, pa.string())


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What ``F.round`` gives: the shortest decimal form of each number, rounded half up."""
    scaled = x * 10.0**digits
    below = np.floor(scaled)
    out = np.floor(scaled + 0.5) / 10.0**digits
    # near a half, or too large for whole numbers, the digits decide
    unsure = np.isfinite(x) & ((np.abs(scaled - below - 0.5) < 1e-3) | (np.abs(scaled) > 1e12))
    step = Decimal(1).scaleb(-digits)
    with localcontext(prec=400):
        for i in np.flatnonzero(unsure):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x)
