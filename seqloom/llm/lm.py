"""Document scores by a gated recurrent language model, trained in numpy inside Spark tasks.

Counting covers every training token and is one shuffle of word hashes.  The most frequent words are modelled
one by one, in classes of equal size; the others form classes by frequency, inside which a word has its share
of the counts.  The output is factored: first the class, then the word in the class.  A unit with reset and
update gates reads the words; its state is carried across windows to the end of a document and gradients
are cut at the windows' beginnings.

Training is by rounds: every task trains a copy on whole documents of its own, Spark averages the copies.  Each
document is learned from in one of the rounds, all its tokens in order.  The network starts as the count model (its
biases), so that it begins where the base score is.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, grouped, id_remainder, query, sum_vectors, table, texts
from seqloom.llm.hashing import WordHasher

#: The hash that stands for the end of a document.
END = 0x5E4D_0F_D0C
#: Words of the broadcast head at most (16 bytes each); the rest is joined.
HEAD = 1 << 20
#: Modelled words, words in a class, width of the state.
WORDS, IN_CLASS, WIDTH = 4096, 64, 16
WINDOW, LANES, LANES_IN_TRAINING = 32, 256, 96
#: Each document is trained on in one of so many rounds.
ROUNDS = 2
RATE, FIRST = 0.03, 1e-6
#: Characters that are hashed together, tokens that a task holds.
TOGETHER, HELD = 1 << 18, 1 << 22
PART = 1 << 14
#: Tokens whose outputs are worked out together where no gradients are asked for, so that they stay in a core's cache.
OUTPUTS = 1 << 10


def tokens(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(keys, word hashes of each text with END behind them)."""
    hasher = WordHasher()
    for keys, group in grouped(batches, key, text, TOGETHER):
        words, begins = hasher.words(group)
        words = np.insert(words, begins[1:], np.uint64(END))
        begins = (begins + np.arange(len(begins))).tolist()
        yield keys, [words[a:b] for a, b in zip(begins[:-1], begins[1:])]


def count_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, c) of all tokens; a task adds up what it holds before it shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            words, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for _, lists in tokens(batches, key, text):
            held += lists
            n += sum(map(len, lists))
            if n >= HELD:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return texts(docs, key, text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head: hashes in order, the code of each word and log10(c + 0.5); and what the classes hold."""

    hashes: np.ndarray
    codes: np.ndarray
    logs: np.ndarray
    words: int
    bands: int  # classes by frequency: one for each power of two of the other counts in the head
    mass: np.ndarray  # of each class: sum of c + 0.5
    word_mass: np.ndarray  # of each modelled word
    tokens: int  # N
    types: int  # V

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    @property
    def word_classes(self) -> int:
        return -(-self.words // IN_CLASS)

    @property
    def tail(self) -> int:
        """The code of every word outside the head; other codes beyond ``words`` are classes by frequency."""
        return self.words + self.bands

    @property
    def stored(self) -> dict:
        """The fields alone, to be sent to tasks."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def slots(self) -> tuple[np.uint64, np.ndarray]:
        """A shift, and for each value of a hash's bits above it where such hashes begin: about one hash each."""
        bits = len(self.hashes).bit_length()
        shift = np.uint64(64 - bits)
        held = np.bincount((self.hashes >> shift).astype(np.int64), minlength=1 << bits)
        return shift, np.minimum(np.cumsum(held) - held, len(self.hashes) - 1).astype(np.int32)

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the head each token would be, and whether it is there."""
        shift, begins = self.slots
        at = begins[found >> shift]
        later = np.flatnonzero((self.hashes[at] < found) & (at < len(self.hashes) - 1))
        while len(later):
            at[later] += 1
            later = later[(self.hashes[at[later]] < found[later]) & (at[later] < len(self.hashes) - 1)]
        return at, self.hashes[at] == found

    def code(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each token, and its log10(c + 0.5) (0 in the tail)."""
        if not len(self.hashes):
            return np.full(len(found), self.tail, np.int32), np.zeros(len(found))
        at, known = self.find(found)
        return np.where(known, self.codes[at], self.tail).astype(np.int32, copy=False), np.where(known, self.logs[at], 0.0)

    def code_lists(self, lists: list[np.ndarray]) -> list[np.ndarray]:
        """The codes alone of each list, looked up together."""
        found = np.concatenate(lists)
        codes = np.full(len(found), self.tail, np.int32)
        if len(self.hashes):
            at, known = self.find(found)
            codes[known] = self.codes[at[known]]
        return parted(codes, lists)


def parted(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """The values in stretches as long as the lists."""
    ends = np.cumsum([0] + [len(x) for x in like]).tolist()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def head_of(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of a word in the head: as low as HEAD words allow.

    Counts between two steps of the scale go into the head together or not at all.
    """
    scale = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(scale.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # about a thousand
    n = sum(r.c for r in steps)
    types = sum(r.n for r in steps)
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        if held + r.n > HEAD:
            break
        least, held = r.step, held + r.n
    rows = counts.filter(scale >= F.lit(1 << 30 if least is None else least)).toArrow()  # at most HEAD rows
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))
    words = min(WORDS, len(h))
    codes = np.empty(len(h), np.int64)
    codes[order] = np.arange(len(h))
    band = np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
    bands = int(band[codes >= words].max(initial=-1)) + 1
    codes = np.where(codes < words, codes, words + band)
    word_mass = c[order[:words]] + 0.5
    classes = -(-words // IN_CLASS)
    mass = np.zeros(classes + bands + 1)
    np.add.at(mass, np.where(codes < words, codes // IN_CLASS, classes + codes - words), c + 0.5)
    mass[-1] = n + 0.5 * (types + 1) - mass.sum()
    by_hash = np.argsort(h)
    known = h[by_hash], codes[by_hash].astype(np.int32), np.log10(c + 0.5)[by_hash]
    found = Vocabulary(*known, words, bands, mass, word_mass, n, types)
    return found, 1 << 30 if least is None else least


def cuts(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of even shares of ``n`` things, each of at most ``most``."""
    k = -(-n // most)
    for i in range(k):
        yield i * n // k, (i + 1) * n // k


def side_by_side(ends: list[int], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches (number, begin, end) of at most ``most`` things between the ends, in groups of at most as many."""
    held, n = [], 0
    for k, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
        for a, b in ((0, end - start),) if 0 < end - start <= most else cuts(end - start, most):
            if held and n + b - a > most:
                yield held
                held, n = [], 0
            held.append((k, start + a, start + b))
            n += b - a
    if held:
        yield held


def softmax(logits: np.ndarray, own: np.ndarray, back: bool, alone: tuple[int, ...] = ()) -> np.ndarray:
    """Natural log of the probability of row ``own`` in each column, each of which is a distribution of its own.

    The logits are used up; with ``back`` they become the gradients of the negative sum.  Columns ``alone`` are added
    up in pairs, as numpy adds an array of one column, the others row by row.
    """
    at = np.arange(len(own))
    logits -= logits.max(0)
    found = logits[own, at]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    for i in alone:
        total[i] = logits[:, i].sum()
    if back:
        logits /= total
        logits[own, at] -= 1.0
    return found - np.log(total)


class Network:
    """A gated recurrent unit with a class-factored softmax; all parameters are views of one vector."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        self.words, self.classes, self.word_classes = v.words, len(v.mass), v.word_classes
        shapes = {
            "inputs": (v.words + v.bands + 1, 3 * WIDTH),
            "state": (WIDTH, 3 * WIDTH),
            "to_class": (WIDTH, self.classes),
            "class_bias": (self.classes,),
            "to_word": (self.word_classes, WIDTH, IN_CLASS),
            "word_bias": (self.word_classes, IN_CLASS),
        }
        self.size = sum(math.prod(s) for s in shapes.values())
        self.flat = np.zeros(self.size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        if flat is None:
            dice = np.random.default_rng(11)
            self.inputs[:] = dice.standard_normal(self.inputs.shape) * 0.3
            self.state[:] = dice.standard_normal(self.state.shape) / math.sqrt(WIDTH)
            self.class_bias[:] = np.log(np.maximum(v.mass, 1e-9) / v.total)
            padded = np.full(self.word_classes * IN_CLASS, 1e-30)
            padded[: v.words] = v.word_mass
            self.word_bias[:] = np.log(padded.reshape(-1, IN_CLASS))

    def run(self, codes: np.ndarray, first: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``codes`` and ``first`` (state starts anew) are steps x lanes.

        Inside, lanes are columns, so that each gate lies in whole rows.
        """
        steps, n = codes.shape
        held = 1 if keep is None else steps  # without gradients all steps share their room
        out = np.empty((steps, WIDTH, n), np.float32)
        told, gates = np.empty((held, 3 * WIDTH, n), np.float32), np.empty((held, 2 * WIDTH, n), np.float32)
        news, less = np.empty((2, held, WIDTH, n), np.float32)
        rooms = list(zip(told, told[:, : 2 * WIDTH], told[:, 2 * WIDTH :], gates, gates[:, :WIDTH], gates[:, WIDTH:], news, less))
        rooms *= steps // held
        state, on, anew, h = self.state.T.copy(), (~first).astype(np.float32), first.any(1).tolist(), np.ascontiguousarray(h.T)
        state[: 2 * WIDTH] *= 0.5  # a gate is 0.5 + 0.5 tanh of half its sum
        if keep is not None:
            keep.append((h, out, told, gates, news, less))
        for start in range(0, steps, WINDOW):
            reads = np.ascontiguousarray(np.take(self.inputs, codes[start : start + WINDOW], axis=0).transpose(0, 2, 1))
            reads[:, : 2 * WIDTH] *= 0.5
            for t, (to_gates, to_new) in enumerate(zip(reads[:, : 2 * WIDTH], reads[:, 2 * WIDTH :]), start):
                u, u_gates, u_new, g, z, r, new, change = rooms[t]
                after = out[t]
                if anew[t]:
                    h = h * on[t]
                np.matmul(state, h, out=u)
                np.add(to_gates, u_gates, out=g)
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                np.multiply(r, u_new, out=new)
                new += to_new
                np.tanh(new, out=new)
                np.subtract(h, new, out=change)
                np.multiply(z, change, out=after)
                after += new
                h = after
        return out.transpose(0, 2, 1)

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.words, codes // IN_CLASS, self.word_classes + codes - self.words)

    def log_probabilities(self, h: np.ndarray, codes: np.ndarray, grads: Network | None = None):
        """Natural log of P(class) P(word in class) of each row; a class by frequency counts as one word.

        With ``grads``, which holds zeros, also puts the gradients of their negative sum there and returns those of ``h``.
        """
        # classes x rows: sums over classes then run along whole rows
        found, back = np.empty(len(codes), np.float32), None
        most = OUTPUTS if grads is None else max(1, len(codes))
        own = self.class_of(codes)
        for a, b in cuts(len(codes), most):
            p = self.to_class.T @ h[a:b].T
            p += self.class_bias[:, None]
            found[a:b] = softmax(p, own[a:b], grads is not None)
            if grads is not None:
                grads.to_class += (p @ h).T
                grads.class_bias += p.sum(1)
                back = np.ascontiguousarray((self.to_class @ p).T)
        order = np.argsort(own.astype(np.min_scalar_type(self.classes)), kind="stable")
        ends = np.searchsorted(own[order], np.arange(self.word_classes + 1)).tolist()
        order = order[: ends[-1]]
        sorted_h, word = np.take(h, order, axis=0), codes[order] % IN_CLASS
        for group in side_by_side(ends, most):
            start, end = group[0][1], group[-1][2]
            p = np.empty((end - start, IN_CLASS), np.float32)
            for k, a, b in group:
                q = p[a - start : b - start]
                np.matmul(sorted_h[a:b], self.to_word[k], out=q)
                q += self.word_bias[k]
            p = np.ascontiguousarray(p.T)
            alone = tuple(a - start for _, a, b in group if b == a + 1)
            found[order[start:end]] += softmax(p, word[start:end], grads is not None, alone)
            if grads is not None:
                of_h = np.empty((WIDTH, end - start), np.float32)
                for k, a, b in group:
                    q = p[:, a:b]
                    np.matmul(sorted_h[a:b].T, q.T, out=grads.to_word[k])
                    np.add.reduce(q, 1, out=grads.word_bias[k])
                    np.matmul(self.to_word[k], q, out=of_h[:, a:b])
                back[order] += of_h.T
        return found, back

    def backward(self, codes: np.ndarray, first: np.ndarray, keep: list, back: np.ndarray, grads: Network) -> np.ndarray:
        """Gradients through the window's steps, put where ``grads`` holds zeros; returns the codes read: other inputs have none."""
        h, out, told, gates, news, less = keep[0]
        steps, n = codes.shape
        on, anew = (~first).astype(np.float32), first.any(1).tolist()
        back, others, slopes = np.ascontiguousarray(back.transpose(0, 2, 1)), 1 - gates, 1 - news * news
        du, ahead = np.empty((steps, 3 * WIDTH, n), np.float32), np.empty((steps, WIDTH, n), np.float32)
        rows, (d, of_state) = np.empty((steps, n, 3 * WIDTH), np.float32), np.zeros((2, WIDTH, n), np.float32)
        parts = (back, rows, less, told[:, 2 * WIDTH :], gates, gates[:, :WIDTH], gates[:, WIDTH:], others, others[:, :WIDTH], slopes, ahead,
                 du, du[:, :WIDTH], du[:, WIDTH : 2 * WIDTH], du[:, : 2 * WIDTH], du[:, 2 * WIDTH :])
        steps_back = zip(range(steps - 1, -1, -1), *(x[::-1] for x in parts))
        for t, told_back, row, change, un, g, z, r, not_g, not_z, slope, dn, own, dz, dr, pair, dun in steps_back:
            d += told_back
            np.multiply(d, not_z, out=dn)
            dn *= slope
            np.multiply(d, change, out=dz)
            np.multiply(dn, un, out=dr)
            pair *= g
            pair *= not_g
            np.multiply(dn, r, out=dun)
            row[:] = own.T
            np.matmul(self.state, row.T, out=of_state)
            d *= z
            d += of_state
            if anew[t]:
                d *= on[t]
        before = np.empty((steps, n, WIDTH), np.float32)
        before[0], before[1:] = h.T, out[:-1].transpose(0, 2, 1)
        before *= on[:, :, None]
        grads.state += np.ascontiguousarray(np.matmul(du, before)[::-1]).sum(0).T  # the last step first
        rows[:, :, 2 * WIDTH :] = ahead.transpose(0, 2, 1)
        flat = codes.ravel()
        order = np.argsort(flat.astype(np.min_scalar_type(len(self.inputs))), kind="stable")
        read = flat[order]
        starts = np.flatnonzero(np.diff(read, prepend=-1))
        sizes, rows = np.diff(starts, append=len(read)), rows.reshape(-1, 3 * WIDTH)
        sums, many = np.take(rows, order[starts], axis=0), sizes > 1  # most codes are read once
        if many.any():
            again = np.take(rows, order[np.repeat(many, sizes)], axis=0)
            sums[many] = np.add.reduceat(again, np.cumsum(sizes[many]) - sizes[many])
        grads.inputs[read[starts]] = sums
        return read[starts]

    def descend(self, grads: Network, squares: np.ndarray, read: np.ndarray, n: int) -> None:
        """A step against the gradients over ``n`` tokens, which become zeros; of the inputs, only those read have any."""
        n, size = np.float32(n), self.inputs.size
        g, own = grads.inputs[read] / n, squares[:size].reshape(self.inputs.shape)
        sums = own[read] + g * g
        own[read] = sums
        self.inputs[read] -= RATE * g / np.sqrt(sums)
        grads.inputs[read] = 0
        g, own = grads.flat[size:], squares[size:]
        g /= n
        own += g * g
        g *= RATE
        g /= np.sqrt(own)
        self.flat[size:] -= g
        g[:] = 0


def lanes(lists: list[np.ndarray], n: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of lists laid end to end in ``n`` lanes: (codes read, codes to tell, list numbers, list begins).

    Steps x lanes; a list number of -1 is padding.  Lists go to the lane that is shortest so far, the longest first.
    """
    sizes = np.array([len(x) for x in lists])
    n = max(1, min(n, len(lists), int(sizes.sum() // max(1, sizes.max())) + 1))
    ends = [(0, i) for i in range(n)]
    held: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable"):
        size, lane = heapq.heappop(ends)
        held[lane].append(int(i))
        heapq.heappush(ends, (size + int(sizes[i]), lane))
    length = -(-max(e for e, _ in ends) // window) * window
    tell = np.zeros((n, length), np.int32)
    owner = np.full((n, length), -1, np.int32)
    first = np.zeros((n, length), bool)
    for lane, own in enumerate(held):
        at = 0
        for i in own:
            tell[lane, at : at + sizes[i]] = lists[i]
            owner[lane, at : at + sizes[i]] = i
            first[lane, at] = True
            at += int(sizes[i])
    read = np.roll(tell, 1, axis=1)
    for start in range(0, length, window):
        cut = slice(start, start + window)
        yield read[:, cut].T, tell[:, cut].T, owner[:, cut].T, first[:, cut].T


def train(docs: DataFrame, v: Vocabulary, scratch: Scratch, key: str, text: str) -> np.ndarray:
    """The parameters after ROUNDS rounds; each round trains on other documents, whole ones, and all rounds on all."""
    spark = docs.sparkSession
    flat = Network(v).flat
    words = spark.sparkContext.broadcast(v.stored)  # at most HEAD words
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Vocabulary(**words.value)
            net, seen = Network(own, start.value), 0
            squares, grads = np.full(net.size, FIRST, np.float32), Network(own, np.zeros(net.size, np.float32))
            held, n = [], 0

            def learn():
                end = own.code(np.array([END], np.uint64))[0][0]
                state = None
                for read, tell, owner, first in lanes(held, LANES_IN_TRAINING):
                    read = np.where(first, end, read)
                    state = np.zeros((read.shape[1], WIDTH), np.float32) if state is None else state
                    keep: list = []
                    states = net.run(read, first, state, keep)
                    live = owner.ravel() >= 0
                    tokens_here = int(live.sum())
                    if tokens_here == live.size:
                        live = slice(None)
                    back = np.zeros((owner.size, WIDTH), np.float32)
                    _, back[live] = net.log_probabilities(states.reshape(-1, WIDTH)[live], tell.ravel()[live], grads)
                    codes = net.backward(read, first, keep, back.reshape(states.shape), grads)
                    net.descend(grads, squares, codes, tokens_here)
                    state = states[-1]

            for _, lists in tokens(batches, key, text):
                some = [x for x in lists if (int(x[0] ^ np.uint64(len(x))) + turn) % ROUNDS == 0]
                if some:
                    held += own.code_lists(some)
                    n += sum(map(len, some))
                if n >= HELD // 4:
                    learn()
                    seen, held, n = seen + n, [], 0
            if held:
                learn()
                seen += n
            if seen:
                vector = np.append(net.flat.astype(np.float64) * seen, seen)
                parts = [zlib.compress(vector[i : i + PART].tobytes(), 1) for i in range(0, len(vector), PART)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "vector"]
                )

        total = sum_vectors(scratch.keep(texts(docs, key, text).mapInArrow(run, "part int, vector binary")), np.float64)
        if total is not None:
            flat = (total[:-1] / total[-1]).astype(np.float32)
    return flat


def score_head(docs: DataFrame, v: Vocabulary, flat: np.ndarray, key: str, text: str) -> DataFrame:
    """For each row what the head and the network say, and the words that are left to the tail's counts."""
    kind = docs.schema[key].dataType.simpleString()
    words, parameters = (docs.sparkSession.sparkContext.broadcast(x) for x in (v.stored, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(**words.value)
        net = Network(own, parameters.value)
        log_mass = np.log10(np.maximum(own.mass, 1e-300))
        tenth = 1.0 / math.log(10.0)
        end = own.code(np.array([END], np.uint64))[0][0]
        held: list = []

        def counted(lists):
            """Codes of a group's texts, and what the head's counts say of each: base, known, shares of classes; the tail's words."""
            h, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
            code, log = own.code(h)
            of = np.repeat(np.arange(len(lists)), sizes)
            tail = np.flatnonzero(code == own.tail)
            rare = np.flatnonzero((code >= own.words) & (code != own.tail))
            base = np.add.reduceat(log, np.cumsum(sizes) - sizes) - sizes * math.log10(own.total)
            tails = np.bincount(of[tail], minlength=len(lists))
            # inside a class by frequency a word has its share of the class
            shares = np.bincount(of[rare], log[rare] - log_mass[own.word_classes + code[rare] - own.words], len(lists))
            of, h = of[tail], h[tail]
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            begins = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))[: len(h)])
            words, times = h[begins].view(np.int64), np.diff(begins, append=len(h))
            return parted(code, lists), base, sizes - tails, shares - tails * log_mass[-1], words, times, np.bincount(of[begins], minlength=len(lists))

        def out():
            keys, rids, lists, base, known, shares, words, times, distinct = zip(*held)
            codes = [c for group in lists for c in group]
            score = np.zeros(len(codes))
            state = None
            for read, tell, owner, first in lanes(codes, LANES, 4 * WINDOW):
                read = np.where(first, end, read)
                state = np.zeros((read.shape[1], WIDTH), np.float32) if state is None else state
                states = net.run(read, first, state)
                state = states[-1]
                live = owner.ravel() >= 0
                found, _ = net.log_probabilities(states.reshape(-1, WIDTH)[live], tell.ravel()[live])
                score += np.bincount(owner.ravel()[live], found.astype(np.float64), len(codes))
            score *= tenth
            score += np.concatenate(shares)
            where = pa.array(np.append(0, np.cumsum(np.concatenate(distinct))).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.concat_arrays(rids), pa.array([len(c) for c in codes], pa.int64()),
                 pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(base)), pa.array(score),
                 pa.ListArray.from_arrays(where, pa.array(np.concatenate(words))),
                 pa.ListArray.from_arrays(where, pa.array(np.concatenate(times).astype(np.int64)))],
                [key, "rid", "n_tokens", "known", "base", "score", "words", "times"],
            )

        n = 0
        for batch in batches:
            start = 0
            for keys, lists in tokens(iter([batch]), key, text):
                held.append((keys, batch.column("rid").slice(start, len(lists)), *counted(lists)))
                start += len(lists)
                n += sum(map(len, lists))
                if n >= HELD:
                    yield out()
                    held.clear()
                    n = 0
        if held:
            yield out()

    rows = texts(docs, key, text).withColumn("rid", F.xxhash64(key, text))
    return rows.mapInArrow(
        run,
        f"{key} {kind}, rid long, n_tokens long, known long, base double, score double, words array<long>, times array<long>",
    )


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A null or empty text has one token, its end.  A training table without rows knows no word, and every token is
    the one unseen type.  Rows with equal keys are scored one by one; rows that also have equal texts get equal scores.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(count_words(training, key, text))
    v, least = head_of(counts)
    flat = train(training, v, scratch, key, text)
    rows = scratch.keep(score_head(docs, v, flat, key, text))
    # the tail: words outside the head, none of which is frequent
    rare = counts.filter(F.floor(F.log2("c") * 16) < least)
    left = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("h"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    told = left.hint("merge").join(rare, "h", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("met")
    )
    copies = rows.groupBy("rid").agg(F.count("*").alias("copies"))
    told = copies.join(told, "rid", "left").select(
        "rid", (F.coalesce("logs", F.lit(0.0)) / F.col("copies")).alias("logs"),
        (F.coalesce("met", F.lit(0)) / F.col("copies")).cast("long").alias("met"),
    )
    return rows.drop("words", "times").join(told, "rid").select(
        key,
        "n_tokens",
        (F.col("known") + F.col("met")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs")).alias("base_score"),
        (F.col("score") + F.col("logs")).alias("score"),
    )


#: Documents whose remainder is HELD_OUT are not learned from.
FOLDS, HELD_OUT = 5, 1


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document by counts and by the recurrent model."""
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), FOLDS)
    found = score(docs, docs.filter(remainder != HELD_OUT))
    return found.select("doc_id", (remainder == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
