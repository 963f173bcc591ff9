"""Byte-level BPE encoding and decoding as a tree reduction over token lists.

A text is cut by the vocabulary's pattern; every match is encoded on its own.  A match is encoded in
halves, and two encoded halves are joined by encoding a window of the tokens around the boundary
again.  The window grows until the token before it and its first token, and its last token and the
token after it, are each what the merges make of the pair's bytes.  Then all neighbours in the joined
list are: merges cannot cross a boundary between tokens whose pair alone would not be merged across,
as the merges inside a stretch happen in the same order whatever stands beside it.  So the joined
list is the encoding of the whole.  Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import fields, query, small, table, texts

#: Bytes that are merged outright; longer matches are joined from halves.
LEAF = 4
#: Matches of up to so many characters, leaves and pairs of tokens are remembered, as many as fit in MEMORY entries each.
SHORT, MEMORY = 64, 400_000
#: Bytes up to which the lowest rank is looked for among all, without a heap.
SCANNED = 64
#: Ids that are handed over together.
HANDED = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Remembered(dict):
    """Matches and their ids; one that is not known is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> tuple[int, ...]:
        return self.encode(match)


class Encoder:
    """Merges, joins and decodes by one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.known = Remembered(self.encode_match)

    def merge(self, part: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none is in the table."""
        ranks = self.ranks
        n = len(part)
        if n < 2:
            return [ranks[part]] if n else []
        if n <= SCANNED:
            return self._scanned(part)
        ends = list(range(1, n + 1))  # token i covers part[i:ends[i]]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(part[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] == n or ends[ends[i]] != end:
                continue
            gone = ends[i]
            alive[gone] = False
            ends[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(part[i : ends[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[end]))
            left = before[i]
            if left >= 0:
                rank = ranks.get(part[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i : ends[i]]])
            i = ends[i]
        return out

    def _scanned(self, part: bytes) -> list[int]:
        ranks, none = self.ranks, 1 << 40
        tokens = [part[i : i + 1] for i in range(len(part))]
        own = [ranks.get(part[i : i + 2], none) for i in range(len(part) - 1)]
        while own and (least := min(own)) < none:
            i = own.index(least)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del own[i]
            if i:
                own[i - 1] = ranks.get(tokens[i - 1] + tokens[i], none)
            if i < len(own):
                own[i] = ranks.get(tokens[i] + tokens[i + 1], none)
        return [ranks[token] for token in tokens]

    def pair(self, a: int, b: int) -> list[int]:
        """What the merges make of the bytes of two tokens."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return found

    def settled(self, a: int, b: int) -> bool:
        """Whether the merges keep ``a`` and ``b`` apart when they stand alone."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together."""
        if not left or not right:
            return left + right
        window = self.pairs.get((left[-1], right[0])) or self.pair(left[-1], right[0])
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            if (i == 0 or self.settled(left[i - 1], window[0])) and (
                j == len(right) or self.settled(window[-1], right[j])
            ):
                return left[:i] + window + right[j:]
            size *= 2
            window = self.merge(self.decode(left[-size:] + right[:size]))

    def tree(self, part: bytes) -> list[int]:
        if len(part) > LEAF:
            half = len(part) // 2
            return self.join(self.tree(part[:half]), self.tree(part[half:]))
        found = self.leaves.get(part)
        if found is None:
            if len(self.leaves) > MEMORY:
                self.leaves.clear()
            found = self.leaves[part] = self.merge(part)
        return found

    def encode_match(self, match: str) -> tuple[int, ...]:
        part = match.encode("utf-8")
        whole = self.ranks.get(part)
        found = (whole,) if whole is not None else tuple(self.tree(part))
        if len(match) <= SHORT:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known[match] = found
        return found

    def encode(self, text: str) -> array:
        """The ids of a text of any length; matches are taken in blocks."""
        out = array("i")
        if len(text) <= 1 << 20:
            out.extend(chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(text))))
            return out
        matches = self.pattern.finditer(text)
        while block := [m.group() for m in islice(matches, 1 << 16)]:
            out.extend(chain.from_iterable(map(self.known.__getitem__, block)))
        return out

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _lists(ids: list[array]) -> pa.Array:
    flat, ends = array("i"), array("i", [0])
    for one in ids:
        flat.extend(one)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _encoding(ranks, pattern: str, key: str, text: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        names = [key, *keep, "ids"]
        for batch in small(batches):
            own, ids, size, start = batch.select([key, *keep]), [], 0, 0
            for i, one in enumerate(batch.column(text).to_pylist()):
                ids.append(encoder.encode(one))
                size += len(ids[-1])
                if size >= HANDED:
                    yield pa.RecordBatch.from_arrays([*own.slice(start, len(ids)).columns, _lists(ids)], names)
                    ids, size, start = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*own.slice(start, len(ids)).columns, _lists(ids)], names)

    return run


def _decoding(ranks, key: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, "")
        for batch in small(batches):
            column = batch.column("ids")
            decoded = [encoder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in column]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, (key, *keep)), column, pa.array(decoded, pa.binary())], [key, *keep, "ids", "decoded"]
            )

    return run


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, columns to keep, ids array<int>) for every row.

    A null or empty text has no ids.  Rows with equal keys are encoded one by one; other columns are
    not read.  Special tokens in a text are ordinary text.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: fixed size
    schema = f"{fields(docs, key, *keep)}ids array<int>"
    return texts(docs, key, text, keep).mapInArrow(_encoding(ranks, pattern, key, text, keep), schema)


def decode(ids: DataFrame, path: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, ids, decoded binary): the bytes of every row's ids; null ids decode to no bytes."""
    ranks = ids.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = f"{fields(ids, key, *keep)}ids array<int>, decoded binary"
    return ids.select(key, *keep, "ids").mapInArrow(_decoding(ranks, key, keep), schema)


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes decoded from them."""
    return round_trip(table(spark, sf_dir, "documents")).drop("ids")


def round_trip(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, columns to keep, n_tokens, ids_sha256, decoded_sha256, ids)."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    there, back = _encoding(ranks, public_tokenizers.PATTERN, key, text, keep), _decoding(ranks, key, keep)
    schema = f"{fields(docs, key, *keep)}ids array<int>, decoded binary"
    # both ways in one worker per task
    both = texts(docs, key, text, keep).mapInArrow(lambda batches: back(there(batches)), schema)
    return both.select(
        key,
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )
