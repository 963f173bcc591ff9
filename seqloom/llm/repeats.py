"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of DEPTH bytes that covers it also starts earlier: in a smaller document, or earlier in
the same one.  Equal strings have equal anchors: the anchor of a string is its least GRAM-byte hash (the
leftmost of equal ones), and consecutive strings mostly share theirs.  So the strings are dealt by anchor, each
belongs to one, and only anchors that occur more than once are looked at.

An anchor's occurrences with the same bytes around it are one: all but the first are repeats as a whole.  Where
the bytes around it differ, the strings at the anchor are put in suffix order, which their first DEPTH bytes decide.
A suffix has a longest previous factor of DEPTH or more if, in that order and without meeting a common prefix
shorter than DEPTH, there is a smaller position before it or after it.  An anchor with more than SORTED strings is not
sorted in one task: its strings are dealt by 128-bit digests of their own, and all but the first of a digest are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import Scratch, query, small, table, with_size_check
from seqloom.llm.hashing import BASE, INVERSE, mix, powers
from seqloom.operators.quantiles import skewed_lookup
from seqloom.session import spread_rows

DEPTH, GRAM = 100, 24
#: Bytes that are looked at together; a longer text is taken in overlapping slices.
TOGETHER = 1 << 19
#: Strings that are put in suffix order together; an anchor with more has its strings dealt by their digests.
SORTED = 1 << 18
#: Up to so many documents with repeats (12 bytes each) are sent to all tasks; beyond that they are joined.
SENT = 1 << 21
#: A posting's place: the anchor's byte offset, and how far before it its first and last string start.
PLACE = "place long, far int, near int"


class Anchors:
    """Finds the anchors of many texts at once."""

    def __init__(self, depth: int, gram: int):
        self.depth, self.gram = depth, gram
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def of(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(part, place, far, near, anchor hash, hash of all bytes its strings cover), an entry per anchor.

        The strings of the anchor at ``place`` start at place - far ... place - near.
        """
        data = b"".join(parts)
        a = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        none = np.empty(0, np.int64)
        if len(a) < self.depth:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        if len(a) + 1 > len(self.up):
            self.up, self.down = powers(BASE, len(a) + 1), powers(INVERSE, len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=sums[1:])
        g = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(a) + 1 - self.gram]
        g = mix(g)
        # hash above, place below: the least is the least hash, and the leftmost of equal ones
        low = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
        width, have = self.depth - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        owner = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(len(owner))
        part = np.searchsorted(ends, start, "right")
        inside = start + self.depth <= ends[part]
        start, owner, part = start[inside], owner[inside], part[inside]
        if not len(start):
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        # two texts' anchors are never one, as a string ends before the next text begins
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        lasts = np.append(begins[1:], len(start)) - 1
        anchor, i0, i1, part = owner[begins], start[begins], start[lasts], part[begins]
        far, near = anchor - i0, anchor - i1
        whole = (sums[i1 + self.depth] - sums[i0]) * self.down[i0]
        whole = mix(whole + (far * 1024 + near).astype(np.uint64))
        offsets = ends - [len(p) for p in parts]
        return part, anchor - offsets[part], far, near, g[anchor], whole


def slices(text: bytes, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) pieces that hold every string of ``depth`` bytes once."""
    for offset in range(0, max(1, len(text) - depth + 1), TOGETHER):
        yield offset, text[offset : offset + TOGETHER + depth - 1]


def postings(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """(anchor, whole, doc, tag, place, far, near, sure) of every anchor of every text.

    Of equal texts in a task only the first is posted, and those of smaller keys than any before.  Entries that are
    known to be repeats are ``sure`` and have anchors of their own, so that a frequent passage does not meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(depth, gram)
        least: dict[bytes, int] = {}
        parts, owners, size = [], [], 0

        def out():
            part, place, far, near, anchor, whole = finder.of(parts)
            doc, tag, offset = (np.array(x, np.int64)[part] for x in zip(*owners))
            place += offset
            # of equal entries all but the first are repeats whatever else there is: they need not meet their anchor
            order = np.lexsort((place, doc, whole, anchor))
            again = order[1:][(np.diff(anchor[order]) == 0) & (np.diff(whole[order]) == 0)]
            sure = np.zeros(len(order), bool)
            sure[again] = True
            anchor[again] = mix(whole[again] + (doc[again] * 0x10001 + place[again]).astype(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(tag.astype(np.int32)),
                 pa.array(place), pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(sure)],
                ["anchor", "whole", "doc", "tag", "place", "far", "near", "sure"],
            )

        for batch in small(batches):
            for doc, tag, one in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text"))):
                raw = one.encode("utf-8")
                if len(raw) < depth:
                    continue
                digest = xxhash.xxh3_128_digest(raw)
                if least.get(digest, doc + 1) <= doc:
                    continue
                least[digest] = doc
                for offset, piece in slices(raw, depth):
                    parts.append(piece)
                    owners.append((doc, tag, offset))
                    size += len(piece)
                    if size >= TOGETHER:
                        yield out()
                        parts, owners, size = [], [], 0
        if parts:
            yield out()

    return docs.mapInArrow(run, f"anchor long, whole long, doc long, tag int, {PLACE}, sure boolean")


def suffix_order(groups: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of suffixes by group, then by their bytes, given as big-endian words (suffixes x words)."""
    return np.lexsort((*words.T[::-1], groups))


def has_longer_previous(groups: np.ndarray, words: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether each suffix's longest previous factor in its group is as long as its words.

    In suffix order, stretches without a shorter common prefix hold the equal suffixes; the previous smaller position
    in the stretch, or the next smaller one, is then an earlier match.  Positions order all occurrences.
    """
    order = suffix_order(groups, words)
    # ranks, so that stretch * span stays below the square of the number of suffixes
    w, g, p = words[order], groups[order], np.unique(position, return_inverse=True)[1].ravel()[order]
    common = (g[1:] == g[:-1]) & (w[1:] == w[:-1]).all(1)
    stretch = np.cumsum(np.append(True, ~common)) - 1
    span = int(p.max()) + 1 if len(p) else 1
    # running minimum inside stretches, from the left and from the right
    left = np.minimum.accumulate(p - stretch * span) + stretch * span
    turned = stretch[-1] - stretch if len(p) else stretch
    right = np.minimum.accumulate((p - turned * span)[::-1])[::-1] + turned * span
    out = np.empty(len(p), bool)
    out[order] = (left < p) | (right < p)
    return out


def resolve(rows: list[tuple], depth: int) -> list[tuple[int, int, int, int]]:
    """(doc, tag, start, end) of repeated bytes, for the occurrences of some anchors: (anchor, doc, tag, place, far, near, bytes)."""
    rows = sorted(rows, key=lambda r: (r[1], r[3]))
    anchor, doc, tag, place, far, near = (np.array(x) for x in list(zip(*rows))[:6])
    covered = [r[6] for r in rows]
    sizes = far - near + 1
    data = np.frombuffer(b"".join(covered) + b"\0" * 8, np.uint8)
    offsets = np.cumsum([0] + [len(c) for c in covered])[:-1]
    row = np.repeat(np.arange(len(rows)), sizes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = offsets[row] + nth
    start = place[row] - far[row] + nth
    steps = range(0, depth - depth % 8, 8)
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | data[i : len(data) - 7 + i]
    last = [eight[at + depth - 8]] if depth % 8 else []  # overlaps the word before it
    words = np.stack([eight[at + s] for s in steps] + last, 1)
    # rows stand in order of document and place, and so do the strings of one offset from their anchor
    group = np.unique(anchor, return_inverse=True)[1].ravel()[row]
    repeat = has_longer_previous(group, words, row * (1 << 20) + nth)
    row, start = row[repeat], start[repeat]
    if not len(row):
        return []
    fresh = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(start) != 1)))
    ends = start[np.append(fresh[1:], len(row)) - 1] + depth
    return list(zip(doc[row[fresh]].tolist(), tag[row[fresh]].tolist(), start[fresh].tolist(), ends.tolist()))


def _needed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the documents in ``keys`` (doc, tag), without shuffling the others where their number allows."""
    keys = keys.select("doc", "tag").distinct()
    return with_size_check(docs, keys, ["doc", "tag"], "left_semi", SENT)


def repeated_spans(scratch: Scratch, docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """(doc, tag, start, end): every byte range that repeats, in pieces; ``docs`` has (doc, tag, text)."""
    same = W.partitionBy("anchor").orderBy("whole", "doc", "place")
    near = postings(docs, depth, gram).select(
        "*",
        F.lag("whole").over(same).alias("whole_before"),
        F.lag("doc").over(same).alias("doc_before"),
        F.lag("place").over(same).alias("place_before"),
        F.lead("whole").over(same).alias("whole_after"),
    )
    near = near.filter(F.col("whole_before").isNotNull() | F.col("whole_after").isNotNull() | F.col("sure"))
    again = (F.col("doc") == F.col("doc_before")) & (F.col("place") == F.col("place_before"))
    repeats = F.coalesce(F.col("whole") == F.col("whole_before"), F.lit(False))
    kind = F.when(F.col("sure"), F.lit(1)).when(repeats & again, F.lit(2)).when(repeats, F.lit(1)).otherwise(F.lit(0))
    near = scratch.keep(near.select("anchor", "doc", "tag", "place", "far", "near", "whole", kind.alias("kind")))
    start, end = F.col("place") - F.col("far"), F.col("place") - F.col("near") + depth
    plain = near.filter("kind = 1").select("doc", "tag", start.alias("start"), end.alias("end"))
    # first occurrences of different bytes around one anchor
    heads = near.filter("kind = 0")
    several = heads.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("far") - F.col("near") + 1).alias("strings"))
    several = several.filter("n > 1").select("anchor", (F.col("strings") > SORTED).alias("frequent"))
    heads = scratch.keep(heads.hint("merge").join(several, "anchor").drop("whole", "kind"))
    mixed = _sorted_spans(_covered(docs, heads.filter(~F.col("frequent")), depth), depth)
    frequent = heads.filter("frequent")
    if frequent.head(1):
        mixed = mixed.unionByName(_dealt_spans(scratch, _covered(docs, frequent, depth), depth))
    return plain.unionByName(mixed)


def _covered(docs: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """(anchor, doc, tag, place, far, near, bytes): the anchors' occurrences with the bytes that their strings cover."""
    held = heads.groupBy("doc", "tag").agg(
        F.collect_list(F.struct("anchor", "place", "far", "near")).alias("anchors")
    )
    texts = _needed(docs, heads).dropDuplicates(["doc", "tag"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc", "tag", "place", "far", "near", "bytes"]
        for batch in small(batches):
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode("utf-8")
                own = batch.column("anchors")[i].values
                anchor, place, far, near = (own.field(c) for c in ("anchor", "place", "far", "near"))
                begins = place.to_numpy() - far.to_numpy()
                ends = place.to_numpy() - near.to_numpy() + depth
                cut = [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
                zero = pa.array(np.zeros(len(own), np.int64))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [anchor, one.column("doc").take(zero), one.column("tag").take(zero), place, far, near, pa.array(cut, pa.binary())],
                    names,
                )

    occurrences = texts.hint("merge").join(held, ["doc", "tag"]).select("doc", "tag", "text", "anchors")
    return occurrences.mapInArrow(cover, "anchor long, doc long, tag int, place long, far int, near int, bytes binary")


def _dealt_spans(scratch: Scratch, occurrences: DataFrame, depth: int) -> DataFrame:
    """(doc, tag, start, end) of repeats among the strings of frequent anchors, each string dealt by its digest."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["high", "low", "doc", "tag", "start"]
        for batch in small(batches):
            doc, tag, place, far, near = (batch.column(c).to_numpy() for c in ("doc", "tag", "place", "far", "near"))
            sizes = (far - near + 1).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            covered = batch.column("bytes").to_pylist()
            digests = b"".join(
                xxhash.xxh3_128_digest(raw[i : i + depth]) for raw, n in zip(covered, sizes.tolist()) for i in range(n)
            )
            both = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc[row]), pa.array(tag[row]),
                 pa.array(place[row] - far[row] + nth)],
                names,
            )

    strings = scratch.keep(occurrences.mapInArrow(deal, "high long, low long, doc long, tag int, start long"))
    first = strings.groupBy("high", "low").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").drop("n")
    # a string may be as frequent as its anchor
    met = skewed_lookup(strings, first, ["high", "low"])
    met = met.filter(F.struct("doc", "start") > F.col("first"))
    return met.select("doc", "tag", "start", (F.col("start") + depth).alias("end"))


def _sorted_spans(occurrences: DataFrame, depth: int) -> DataFrame:
    """(doc, tag, start, end) of repeats among the strings of anchors that have at most SORTED."""
    dealt = occurrences.repartition("anchor").sortWithinPartitions("anchor")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tag", "start", "end"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        held, strings, last = [], 0, None

        def out():
            found = resolve(held, depth)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names) if found else None

        for batch in small(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tag", "place", "far", "near", "bytes"))):
                if row[0] != last and strings >= SORTED:
                    done = out()
                    if done is not None:
                        yield done
                    held, strings = [], 0
                last = row[0]
                held.append(row)
                strings += row[4] - row[5] + 1
        if held:
            done = out()
            if done is not None:
                yield done

    return dealt.mapInArrow(sort, "doc long, tag int, start long, end long")


def remove_repeats(
    docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A null text is empty.  Keys are integers; a null key comes after all others.  Rows that repeat a key and its text
    are one document and get one result.  Rows with one key and different texts are told apart, and count as one
    document where order matters.  ``depth`` is 32 or more and ``gram`` smaller.
    """
    scratch = Scratch(docs.sparkSession)
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = spread_rows(docs.select(F.col(key), plain.alias("text"))).select(
        key,
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.hash("text").alias("tag"),
        "text",
    )
    every = scratch.keep(
        rows.select(key, "doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    )
    first = every.groupBy("sha").agg(F.min("doc").alias("first"))
    spans = scratch.keep(repeated_spans(scratch, rows.select("doc", "tag", "text"), depth, gram))
    held = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = _needed(rows.select("doc", "tag", "text"), spans).dropDuplicates(["doc", "tag"]).hint("merge").join(held, ["doc", "tag"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_removed, n_spans, kept = [], [], []
            for one, own in zip(batch.column("text"), batch.column("spans")):
                raw = np.frombuffer(one.as_py().encode("utf-8"), np.uint8)
                turns = np.zeros(len(raw) + 1, np.int64)
                np.add.at(turns, own.values.field("start").to_numpy(), 1)
                np.add.at(turns, own.values.field("end").to_numpy(), -1)
                gone = np.cumsum(turns[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                kept.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(kept, pa.string())],
                ["doc", "tag", "removed", "runs", "kept"],
            )

    removed = met.select("doc", "tag", "text", "spans").mapInArrow(cut, "doc long, tag int, removed long, runs long, kept string")
    removed = scratch.keep(removed)
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= depth)
    found = every.hint("merge").join(first, "sha").join(removed, ["doc", "tag"], "left")
    return found.select(
        key,
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the hundred-byte strings that occur before."""
    return remove_repeats(table(spark, sf_dir, "documents"))
