"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and tokens that bear loss.  An example asks for some of each.
The open sequence takes, of a pool of examples, the one whose demand has the largest dot product with what the
sequence has left, every dimension weighted by how much of it the pool asks for.  If none fits whole, the one of
the largest product is cut and its rest goes back to the pool.  A sequence that cannot be filled (no segments, loss or
examples left) is cut back to the largest power of two of tokens, which needs no padding, unless it lacks very little.

A task packs its own examples as they come, so nothing is shuffled and memory is that of the pool; a task that
runs again finds the same sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.common import bounded_batches, fields, grouped, query, small, table, texts
from seqloom.llm.hashing import BASE, mix, powers

#: Examples to choose from; more are read when fewer are left.
POOL = 256
#: Sequences that lack at most so many tokens are padded.
PADDED = 8
#: Pieces of rows that are handed over together, by their tokens.
HANDED = 500_000
#: Longest chunk known by its polynomial hash, and how many chunks and ids are remembered.
SHORT, MEMORY = 64, 1 << 20
#: Characters, and bytes, that are tokenized together.
TOGETHER = 1 << 20
#: Kinds of bytes: others, white space, the end of a longer character, marks, digits, letters.
OTHER, SPACE, END, MARK, DIGIT, LETTER = range(6)
KINDS = np.array(
    [SPACE if b in b" \t\n\r" else OTHER if b < 33 or b > 126 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
     for b in range(256)], np.uint8,
)


class Limits(NamedTuple):
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Chunks:
    """Token ids by a ``tokenizers`` file with byte-level pieces; equal chunks are encoded once.

    A chunk ends before white space, and between ASCII letters, digits and marks, but not after an apostrophe.  No piece
    of the tokenizer's pattern goes on there, so the chunks' ids are the text's.  Chunks are known by 64-bit
    hashes.  Special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.scale = powers(BASE, SHORT)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text and the end the number of ids before it."""
        raw = [t.encode("utf-8") for t in texts]
        data = b"".join(raw)
        offsets = np.cumsum([0] + [len(r) for r in raw])
        a = np.frombuffer(data, np.uint8)
        begins = np.zeros(len(a), bool)
        if len(a) > 1:
            kind = KINDS[a]
            kind[1:][(a[:-1] >= 0xC3) & (a[:-1] <= 0xDF)] = END  # ends a letter of two bytes or the like
            before, after = kind[:-1], kind[1:]
            begins[1:] = (after == SPACE) & (before > SPACE) | (before > END) & (after > END) & (before != after) & (a[:-1] != 39)
        begins[offsets[:-1][offsets[:-1] < len(a)]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(a))
        ids, counts, first = [], [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + TOGETHER)))
            one, n = self._window(data, a, bounds[first : last + 1])
            ids.append(one)
            counts.append(n)
            first = last
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return (np.concatenate(ids) if ids else self.ids[:0]), before[np.searchsorted(starts, offsets)]

    def _window(self, data: bytes, a: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks between the bounds, and how many each has."""
        starts, sizes = bounds[:-1], np.diff(bounds)
        places = np.arange(bounds[0], bounds[-1]) - np.repeat(starts, sizes)
        terms = (a[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)) * self.scale[np.minimum(places, SHORT - 1)]
        hashes = mix(np.add.reduceat(terms, starts - bounds[0]) ^ (sizes.astype(np.uint64) << np.uint64(56)))
        for i in np.flatnonzero(sizes > SHORT):
            digest = hashlib.blake2b(data[bounds[i] : bounds[i + 1]], digest_size=8).digest()
            hashes[i] = int.from_bytes(digest, "little")
        own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > MEMORY or len(self.ids) > 8 * MEMORY:
            self.forget()
        place = np.searchsorted(self.hashes, own)
        there = place < len(self.hashes)
        there[there] = self.hashes[place[there]] == own[there]
        new = first[~there]
        if len(new):
            found = self.tokenizer.encode_batch_fast(
                [data[bounds[i] : bounds[i + 1]].decode("utf-8") for i in new], add_special_tokens=False
            )
            lists = [f.ids for f in found]
            n = np.array(list(map(len, lists)), np.int64)
            every = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(every, kind="stable")
            self.hashes = every[order]
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])[order]
            self.sizes = np.concatenate([self.sizes, n])[order]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, n.sum())])
        known = np.searchsorted(self.hashes, own)
        n = self.sizes[known][which]
        shift = self.starts[known][which] - (np.cumsum(n) - n)
        return self.ids[np.repeat(shift, n) + np.arange(n.sum())], n


@cache
def chunks_of(path: str) -> Chunks:
    """One per worker process and file; tasks that follow each other there share what is remembered."""
    return Chunks(path)


class Piece(NamedTuple):
    """A run of an example's tokens; ``loss`` has the running sums of its loss flags, from 0."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            self._replace(ids=self.ids[:n], loss=self.loss[: n + 1]),
            self._replace(start=self.start + n, ids=self.ids[n:], loss=self.loss[n:] - self.loss[n]),
        )

    def most(self, tokens: int, loss: int) -> int:
        """How many of its tokens keep to these limits."""
        return min(tokens, len(self.ids), int(np.searchsorted(self.loss, loss, "right")) - 1)


class Packer:
    """Sequences of one stream of examples."""

    def __init__(self, limits: Limits):
        if min(limits) < 1:
            raise ValueError("limits are 1 or more")
        self.limits = limits
        self.most = np.array(limits, np.float64)
        self.pieces: list[Piece | None] = []
        self.asked = np.zeros((0, 3), np.int64)  # tokens, segments, loss of each piece; zeros in a free place
        self.free: list[int] = []

    def add(self, piece: Piece) -> None:
        if not self.free:
            n = max(64, len(self.pieces))
            self.free = list(range(len(self.pieces) + n - 1, len(self.pieces) - 1, -1))
            self.pieces += [None] * n
            self.asked = np.concatenate([self.asked, np.zeros((n, 3), np.int64)])
        place = self.free.pop()
        self.pieces[place] = piece
        self.asked[place] = len(piece.ids), 1, piece.loss[-1]

    def take(self, place: int) -> Piece:
        piece = self.pieces[place]
        self.pieces[place] = None
        self.asked[place] = 0
        self.free.append(place)
        return piece

    def __len__(self) -> int:
        return len(self.pieces) - len(self.free)

    def sequence(self) -> list[Piece]:
        left, chosen = np.array(self.limits), []
        weight = self.asked.sum(0) / self.most**3
        while len(self) and left[0] and left[1]:
            product = self.asked @ (weight * left)
            fits = (self.asked[:, 0] > 0) & (self.asked[:, 0] <= left[0]) & (self.asked[:, 2] <= left[2])
            best = int(np.argmax(np.where(fits, product, -1.0)))
            if fits[best]:
                piece = self.take(best)
            else:
                piece = self.part(product, left)
                if piece is None:
                    break
            chosen.append(piece)
            left -= len(piece.ids), 1, piece.loss[-1]
        return self.even(chosen, int(left[0]))

    def part(self, product: np.ndarray, left: np.ndarray) -> Piece | None:
        """The beginning of a piece that is too long, of the largest product whose beginning may be added."""
        for place in np.argsort(-product, kind="stable"):
            piece = self.pieces[place]
            if piece is not None and (n := piece.most(int(left[0]), int(left[2]))):
                head, rest = self.take(place).cut(n)
                self.add(rest)
                return head
        return None

    def even(self, chosen: list[Piece], lacking: int) -> list[Piece]:
        """``chosen``, or its beginning of a power of two of tokens, if too many are lacking."""
        n = self.limits.tokens - lacking
        over = n - (1 << (n.bit_length() - 1))
        if lacking <= PADDED or not over:
            return chosen
        while over:
            last = chosen.pop()
            if len(last.ids) > over:
                head, last = last.cut(len(last.ids) - over)
                chosen.append(head)
            over -= len(last.ids)
            self.add(last)
        return chosen


def sequences(examples: Iterator[Piece], limits: Limits, pool: int = POOL) -> Iterator[list[Piece]]:
    """Every token of every example in exactly one sequence."""
    packer = Packer(limits)
    for piece in examples:
        while len(piece.ids):
            head, piece = piece.cut(piece.most(limits.tokens, limits.loss))
            packer.add(head._replace(ids=head.ids.copy(), loss=head.loss.copy()))  # lets a long example go
            while len(packer) >= pool:
                yield packer.sequence()
    while len(packer):
        yield packer.sequence()


def _packing(key: str, limits: Limits, examples: Callable, kind: pa.DataType):
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "n_loss", "ids"]
    longs = pa.int64()

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, *[longs] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rows, size = [], 0
        for sequence in sequences(examples(batches), limits):
            offset = 0
            for p in sequence:
                n = len(p.ids)
                rows.append((p.key, p.start, n, p.total, number, offset, int(p.loss[-1]), p.ids.astype("<u4").tobytes()))
                offset += n
            number, size = number + 1, size + offset
            if size >= HANDED:
                yield handed(rows)
                rows, size = [], 0
        if rows:
            yield handed(rows)

    return run


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, n_loss long, ids binary"


def pack(
    examples: DataFrame, key: str = "doc_id", ids: str = "ids", loss: str | None = None, limits: Limits = Limits()
) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, n_loss, ids binary): every piece and where it lies.

    ``ids``: array<int>, ``loss``: array of 0 and 1, as long as the ids (an error otherwise); None: every token bears
    loss.  ``ids`` of a piece are little-endian unsigned 32-bit.  A null or empty example has no piece; examples of
    equal keys are packed one by one; other columns are not read.
    """
    bounded_batches(examples.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in small(batches):
            flags = batch.column("loss") if loss else [None] * batch.num_rows
            for k, own, flag in zip(batch.column(key).to_pylist(), batch.column("ids"), flags):
                x = own.values.to_numpy(zero_copy_only=False).astype(np.uint32) if own.is_valid else np.empty(0, np.uint32)
                bears = np.ones(len(x), np.int64) if flag is None else np.array(flag.as_py() or [], np.int64)
                if len(bears) != len(x):
                    raise ValueError("loss flags and ids differ in length")
                yield Piece(k, 0, x, np.append(0, np.cumsum(bears != 0)), len(x))

    columns = [F.col(key), F.col(ids).alias("ids"), *([F.col(loss).alias("loss")] if loss else [])]
    chosen = examples.select(*columns)
    return chosen.mapInArrow(_packing(key, limits, read, _arrow(chosen, key)), fields(chosen, key) + SCHEMA)


def pack_texts(
    docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """As ``pack``, of the tokens of texts, each followed by the id ``end``; a null text is the empty text."""
    chosen = texts(docs, key, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        chunks = chunks_of(path)
        for keys, group in grouped(batches, key, text, TOGETHER):
            ids, bounds = chunks.encode(group)
            for k, a, b in zip(keys.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                x = np.append(ids[a:b], np.uint32(end))
                yield Piece(k, 0, x, np.arange(len(x) + 1), len(x))

    return chosen.mapInArrow(_packing(key, limits, read, _arrow(chosen, key)), fields(chosen, key) + SCHEMA)


def _arrow(df: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[key].dataType)


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2,048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pack_texts(table(spark, sf_dir, "documents"), path, end=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
