"""LM scoring by online logistic context mixing.

A text is a row of bytes and one end; each of these 257 symbols is a path of yes-or-no decisions in a prefix code, one code
for each symbol before it, made from the training texts' pair counts. For every decision, predictors look up hashed contexts
(the last two, four and six bytes; the word so far with the word before it) in tables of counts, and one more follows the
last place of the same text that the last `MATCH` bytes stood at. Their logits are mixed with weights that a gate picks: how
many of the longer contexts are known, how long the match has held, and the decision's depth. The gates' weights are
learned on one training text in `TUNE`, which the tables leave out for that; a text's own correction of the weights is
moved after each block of its bytes, blocks growing from `FIRST` to `BLOCK`, and a table of outcomes by mixed logit, kept for
the text as it is read, refines the result. Last, the chance of each word with the sign behind it is averaged with
the word's share of all training words, counted exactly; the share of that average is learned on the same texts. The sum of
the log-probabilities is the text's; over its bytes, that is bits per byte.

All counts come from all training documents. What is gathered grows with them: the tables have as many slots as the
training texts have bytes, up to 2 ** `MOST_BITS` each, as they are broadcast; the table of exact word counts has no bound. Its
`HEAD` most frequent words at most are broadcast, the rest is joined by word.

The base score is a unigram one over the same word counts. Null texts count as empty: one token, the end. Rows without an
id are known by their text's hash; equal rows get equal results. Extra columns stay out. An empty table gives no rows.
Without training documents every count is zero, so base scores are 0 and the model is a uniform one. A text of more than
`PART` bytes is read part by part, and contexts, matches and corrections begin anew with each part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_rows, crc_rest, free, stored, table
from .suffixes import keyed, mixed, powers

LEAST_BITS, MOST_BITS = 16, 22
CHUNK_BITS = 14
ORDERS = (2, 4, 6)
PREDICTORS = len(ORDERS) + 1
INPUTS = PREDICTORS + 1  # and the match
MATCH = ORDERS[-1]
END = START = 256  # the end of a text is what stands before the next one
PAIRS = (END + 1) ** 2
CODE_BITS = 40  # no path is longer
LOGIT_STEP = 1 / 14  # tables hold logits in such steps
GATES = PREDICTORS * 4 * 3
TUNE = 32
PRIOR_WEIGHTS = np.array([1.6 / PREDICTORS] * PREDICTORS + [0.3])
ROUNDS, RIDGE = 3, 2.0
SHARES = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5)  # of the word counts in the last average
FIRST, BLOCK = 8, 256
RATE = 0.0015
REFINE = 24  # classes of the mixed logit
PRIOR = 60.0
SLICE = 256 << 10  # bytes of text that are worked on at once
PART = 1 << 20
HEAD = 1 << 17
FLUSH = 500_000  # words that a task counts before it sends them on

SPACE = np.array([b in b"\t\n\v\f\r " for b in range(256)] + [True])
#: Cases of a word. No capitals, only the first sign, only capitals (two or more), anything else.
LOWER, TITLE, UPPER, OTHER = range(4)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Code:
    """A prefix code of the 257 symbols for each symbol before: every symbol's path of nodes and decisions, at before * 257 + symbol.

    A share of 2 ** -16 of a code's counts is added to each symbol, which bounds the paths' length.
    """

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(END + 1, END + 1)
        every = counts.sum(axis=0)
        size, flat = [], []
        self.path = np.zeros(PAIRS, np.uint64)  # the decisions, the first one highest
        for before in range(END + 1):
            own = counts[before] if counts[before].any() else every
            own = own + (int(own.sum()) >> 16) + 1
            heap = [(int(n), s, s) for s, n in enumerate(own)]
            heapq.heapify(heap)
            kids, fresh = {}, END + 1
            while len(heap) > 1:
                n, _, a = heapq.heappop(heap)
                m, _, b = heap[0]
                heapq.heapreplace(heap, (n + m, fresh, fresh))
                kids[fresh] = (a, b)
                fresh += 1
            paths: list[list[int]] = [[] for _ in range(END + 1)]
            todo = [(heap[0][2], [], 0)]
            while todo:
                x, path, value = todo.pop()
                if x <= END:
                    paths[x] = path
                    self.path[before * (END + 1) + x] = value << (CODE_BITS - len(path))
                else:
                    todo += [(kid, [*path, (before * 256 + x - END - 1) * 2 + side], value * 2 + side) for side, kid in enumerate(kids[x])]
            for p in paths:
                size.append(len(p))
                flat += p
        self.size = np.array(size)
        self.base = np.cumsum(self.size) - self.size
        steps = np.array(flat, np.int64)
        self.node = (steps >> 1).astype(np.uint32) * np.uint32(0x9E3779B1)
        depth = np.arange(len(steps)) - np.repeat(self.base, self.size)
        #: the decision (one bit), a class of how deep it lies (two bits: the first two, the next two, others), and how deep
        self.turn = (np.minimum(depth, 31) << 3 | np.minimum(depth // 2, 2) << 1 | steps & 1).astype(np.uint8)


def in_parts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The texts' parts and each part's text."""
    parts, of = [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PART):
            parts.append(t[at : at + PART])
            of.append(k)
    return parts, np.array(of)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of bytes, in which `MATCH` zeros stand before each text and one behind it, and where the texts begin in it."""
    pad = b"\0" * (MATCH + 1)
    data = np.frombuffer(pad[1:] + pad.join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) + MATCH + 1 for t in texts])
    return data, np.cumsum(sizes) - sizes + MATCH


def places_in(starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the symbols of each text stand, its end too, and each one's text."""
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), owner


def cells(data: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """symbol before * 257 + symbol at every place; only those of texts mean something."""
    syms = data.astype(np.int32)
    syms[starts + np.array([len(t) for t in texts])] = END
    before = np.empty_like(syms)
    before[1:] = syms[:-1]
    before[starts] = START
    before *= END + 1
    before += syms
    return before


def pair_counts(texts: list[bytes]) -> np.ndarray:
    data, starts = laid_out(texts)
    return np.bincount(cells(data, starts, texts)[places_in(starts, texts)[0]], minlength=PAIRS)


#: Odd multipliers of the bytes before, the last one first.
TURNS = (np.arange(1, MATCH + 2, dtype=np.uint64) * STEP >> np.uint64(31)).astype(np.uint32) | np.uint32(1)


def stirred(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return h ^ h >> np.uint32(15)


@lru_cache(maxsize=1)
def small_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and their inverses, modulo 2 ** 32."""
    up, down = powers(int(STEP), n)
    return up.astype(np.uint32), down.astype(np.uint32)


def contexts(data: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts (predictor by place) and of the last `MATCH` bytes; what stands before a text is zeros."""
    n = len(data)
    x = data.astype(np.uint32)
    x += np.uint32(1)
    gaps = starts[:, None] - np.arange(MATCH + 1, 0, -1)
    x[gaps[gaps >= 0]] = 0
    x[-1] = 0
    out = np.empty((PREDICTORS, n), np.uint32)
    held, far = np.zeros(n, np.uint32), 0
    for k, order in enumerate(ORDERS):
        while far < order:
            held[far + 1 :] += x[: n - far - 1] * TURNS[far]
            far += 1
        out[k] = stirred(held)
    # the word so far: what its bytes add up to since it began
    up, down = small_powers(1 << max(20, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum(x * up[:n], out=sums[1:])
    begins = np.zeros(n, np.int64)
    fresh = 1 + np.flatnonzero(spaces(data[:-1]) | (x[:-1] == 0))
    begins[fresh] = fresh
    begins = np.maximum.accumulate(begins)
    word = (sums[:-1] - sums.take(begins)) * down.take(begins)
    at = begins[fresh]
    last = np.zeros(n, np.uint32)
    last[fresh] = word[at - 1]
    out[-1] = stirred(word + last.take(begins) * np.uint32(0x85EBCA6B))
    return out, out[len(ORDERS) - 1]


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def matches(data: np.ndarray, places: np.ndarray, held: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What followed the last place of the same text with the same `MATCH` bytes (-1: none), and a class of how long that has held."""
    n = len(places)
    width = np.uint64(max(1, int(n).bit_length()))
    key = mixed(held[places].astype(np.uint64) | owner.astype(np.uint64) << np.uint64(32)) >> width << width
    listed = np.sort(key | np.arange(n, dtype=np.uint64))
    at = (listed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    same = np.flatnonzero((listed[1:] ^ listed[:-1]) >> width == 0)
    now, then = at[same + 1], at[same]
    whole = (places[now] - starts[owner[now]] >= MATCH) & (places[then] - starts[owner[then]] >= MATCH) & (owner[now] == owner[then])
    now, then = now[whole], then[whole]
    guess = np.full(n, -1, np.int16)
    guess[now] = data[places[then]]
    ends = np.append(np.flatnonzero(np.diff(owner)), n - 1)
    right = guess == data[places]
    right[ends] = False
    wrong = np.maximum.accumulate(np.where(right, -1, np.arange(n)))
    held_for = np.zeros(n, np.int64)
    held_for[1:] = np.arange(n - 1) - wrong[:-1]
    return guess, np.where(guess < 0, 0, np.where(held_for < 4, 1, np.where(held_for < 16, 2, 3))).astype(np.uint8)


class Slice:
    """Texts as symbols, with what the predictors need of each."""

    def __init__(self, code: Code, texts: list[bytes], match: bool = True):
        self.code = code
        data, starts = laid_out(texts)
        places, self.owner = places_in(starts, texts)
        self.place = places - starts[self.owner]
        ctx, held = contexts(data, starts, texts)
        self.ctx = ctx.take(places, axis=1)
        cell = cells(data, starts, texts).take(places)
        self.size, self.base = code.size.take(cell), code.base.take(cell)
        if match:
            guess, self.state = matches(data, places, held, self.owner, starts)
            other = np.where(guess < 0, cell, cell // (END + 1) * (END + 1) + guess)
            apart = code.path.take(cell) ^ code.path.take(other)
            # decisions that the guess and the symbol have in common
            self.common = np.where(guess < 0, -1, np.where(apart == 0, 127, CODE_BITS - np.frexp(apart.astype(np.float64))[1])).astype(np.int8)

    def decisions(self, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the decisions of these symbols one after the other: which symbol, place in the code's arrays; first decision of a symbol."""
        size = self.size[rows]
        ends = np.cumsum(size)
        firsts = ends - size
        of = np.repeat(np.arange(len(size)), size)
        path = (self.base[rows] - firsts).take(of)
        path += np.arange(len(of))
        return of, path, firsts

    def slots(self, k: int, rows: np.ndarray | slice, of: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
        slot = self.ctx[k, rows].take(of)
        slot += node
        slot &= np.uint32((1 << bits) - 1)
        return slot

    def inputs(self, tables: np.ndarray, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decisions, gates, logits (decision by input) and first decision of each symbol."""
        of, path, firsts = self.decisions(rows)
        node, turn = self.code.node.take(path), self.code.turn.take(path)
        bits = int(tables.shape[1]).bit_length() - 1
        x = np.zeros((len(of), INPUTS), np.float32)
        known = np.zeros(len(of), np.uint8)
        for k in range(PREDICTORS):
            own = tables[k].take(self.slots(k, rows, of, node, bits))
            if k:
                known += own != 0
            x[:, k] = own
        x *= np.float32(LOGIT_STEP)
        bit, depth = turn & np.uint8(1), (turn >> np.uint8(3)).view(np.int8)
        common = self.common[rows].take(of)
        state = self.state[rows].take(of)
        state *= depth <= common
        side = (bit ^ (depth == common)).astype(np.float32)
        side *= 2
        side -= 1
        side *= state > 0
        x[:, PREDICTORS] = side
        return bit, (known * np.uint8(4) + state) * np.uint8(3) + (turn >> np.uint8(1) & np.uint8(3)), x, firsts


def fit_tables(docs: DataFrame, code: Code, bits: int) -> np.ndarray:
    """The tables of logits (predictor by slot, in steps of `LOGIT_STEP`) from all texts of docs."""
    chunk = 2 << CHUNK_BITS  # both outcomes of a slot side by side
    shared = docs.sparkSession.sparkContext.broadcast(code)

    def count(batches):
        seen = np.zeros((PREDICTORS, 2 << bits), np.uint32)
        some = False
        for batch in by_bytes(batches, limit=SLICE):
            some = True
            for a in range(0, len(parts := in_parts(byte_rows(batch.column("text")))[0]), 4096):
                own = Slice(shared.value, parts[a : a + 4096], match=False)
                of, path, _ = own.decisions(slice(None))
                node, bit = shared.value.node.take(path), shared.value.turn.take(path) & np.uint8(1)
                for k in range(PREDICTORS):
                    slot = own.slots(k, slice(None), of, node, bits).astype(np.int64)
                    slot <<= 1
                    slot |= bit
                    np.add.at(seen[k], slot, np.uint32(1))
        if some:
            pack = zstandard.ZstdCompressor(level=1)
            for k in range(PREDICTORS):
                rows = seen[k].reshape(-1, chunk)
                packed = [pack.compress(r.tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k)), pa.array(np.arange(len(rows))), pa.array(packed, pa.binary())], names=["predictor", "chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.int64)
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(open_.decompress(x), np.uint32)
        yes, no = total[1::2] + 0.2, total[::2] + 0.2
        logits = np.clip(np.rint(np.log(yes / no) / LOGIT_STEP), -127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([logits.tobytes()], pa.binary())], names=["predictor", "chunk", "logits"])

    parts = docs.select("text").mapInArrow(count, "predictor long, chunk long, counts binary")
    added = parts.groupBy("predictor", "chunk").applyInArrow(add, "predictor long, chunk long, logits binary")
    tables = np.zeros((PREDICTORS, 1 << bits), np.int8)
    for r in added.collect():  # the tables: a bounded number of rows of fixed size
        tables[r.predictor, r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.logits, np.int8)
    return tables


def fit_weights(texts: DataFrame, code: Code, tables: np.ndarray) -> np.ndarray:
    """The gates' weights (gate by input): Newton steps of the logistic loss over all decisions of these texts, near `PRIOR_WEIGHTS`."""
    sc = texts.sparkSession.sparkContext
    model = sc.broadcast((code, tables))
    weights = np.tile(PRIOR_WEIGHTS, (GATES, 1))

    def step(now: np.ndarray):
        def run(batches):
            pull, bend = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
            for batch in by_bytes(batches, limit=SLICE):
                bit, gate, x, _ = Slice(model.value[0], in_parts(byte_rows(batch.column("text")))[0]).inputs(model.value[1], slice(None))
                order = np.argsort(gate, kind="stable")
                ends = np.searchsorted(gate[order], np.arange(GATES + 1))
                for g in range(GATES):
                    own = order[ends[g] : ends[g + 1]]
                    if len(own):
                        a = x[own].astype(np.float64)
                        p = 1 / (1 + np.exp(-np.clip(a @ now[g], -30, 30)))
                        pull[g] += a.T @ (bit[own] - p)
                        bend[g] += (a.T * (p * (1 - p))) @ a
            flat = np.concatenate([pull.ravel(), bend.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "x"])

        return run

    for _ in range(ROUNDS):
        sums = np.zeros(GATES * INPUTS * (INPUTS + 1))
        for r in texts.mapInArrow(step(weights), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            sums[r.k] = r.x
        pull = sums[: GATES * INPUTS].reshape(GATES, INPUTS) - RIDGE * (weights - PRIOR_WEIGHTS)
        bend = sums[GATES * INPUTS :].reshape(GATES, INPUTS, INPUTS) + RIDGE * np.eye(INPUTS)
        weights = weights + np.linalg.solve(bend, pull[:, :, None])[:, :, 0]
    return weights


def log_chances(code: Code, tables: np.ndarray, weights: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """The natural log-probability of every symbol of each text. All texts read their k-th block together; each corrects weights of its own."""
    own = Slice(code, texts)
    n = len(texts)
    borders = [0]
    while borders[-1] <= int(own.place.max()):
        borders.append(borders[-1] + min(BLOCK, FIRST << len(borders) - 1))
    block = np.searchsorted(borders, own.place, side="right")
    order = np.argsort(block, kind="stable")
    steps = np.unique(np.concatenate([[0], np.cumsum(np.bincount(block))]))
    weights = weights.astype(np.float32)
    moved = np.zeros((n, INPUTS), np.float32)
    hits, tries = np.zeros(n * REFINE, np.float32), np.full(n * REFINE, PRIOR, np.float32)
    ones, out = np.ones(INPUTS, np.float32), np.zeros(len(own.owner))
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        rows = order[a:b]
        bit, gate, x, firsts = own.inputs(tables, rows)
        texts_at = np.flatnonzero(np.diff(own.owner[rows], prepend=-1))
        who, begins = own.owner[rows[texts_at]], firsts[texts_at]
        ends = np.append(begins[1:], len(bit))
        w = weights.take(gate, axis=0)
        w *= x
        z = w @ ones
        few = len(bit) > 200 * len(who)  # then text by text is faster
        if few:
            for t, i, j in zip(who.tolist(), begins.tolist(), ends.tolist(), strict=True):
                z[i:j] += x[i:j] @ moved[t]
        else:
            z += np.einsum("ij,ij->i", x, np.repeat(moved[who], ends - begins, axis=0))
        np.clip(z, -14, 14, out=z)
        p = 1 / (1 + np.exp(-z))
        cell = np.repeat((who * REFINE).astype(np.int32), ends - begins)
        cell += ((z + 14) * np.float32((REFINE - 1) / 28)).astype(np.int32)
        final = (p + (hits.take(cell) + np.float32(PRIOR) * p) / tries.take(cell)) * np.float32(0.5)
        np.clip(final, 1e-6, 1 - 1e-6, out=final)
        out[rows] = np.add.reduceat(np.log(np.where(bit, final, 1 - final)), firsts)
        wrong = (bit - p) * np.float32(RATE)
        if few:
            for t, i, j in zip(who.tolist(), begins.tolist(), ends.tolist(), strict=True):
                moved[t] += wrong[i:j] @ x[i:j]
        else:
            x *= wrong[:, None]
            moved[who] += np.add.reduceat(x, begins, axis=0)
        np.clip(moved, -1, 1, out=moved)
        hits += np.bincount(cell[bit.view(bool)], minlength=len(hits)).astype(np.float32)
        tries += np.bincount(cell, minlength=len(tries)).astype(np.float32)
    return np.split(out, np.cumsum([len(t) + 1 for t in texts])[:-1])


def text_chances(code: Code, tables: np.ndarray, weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The texts' symbols' log-probabilities one after the other; a part's end counts with its last sign."""
    parts, of = in_parts(texts)
    found: list[np.ndarray] = []
    for at in range(0, len(parts), 4096):
        found += log_chances(code, tables, weights, parts[at : at + 4096])
    for k in range(len(parts) - 1):
        if of[k] == of[k + 1]:
            found[k][-2] += found[k][-1]
            found[k] = found[k][:-1]
    return np.concatenate(found)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, each with a line end behind it, and begins and ends of all their words."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(spaces(data), prepend=True))
    return data, edge[::2], edge[1::2]


def cases_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The case of each word, which goes from begins to ends."""
    if not len(begins):
        return np.zeros(0, np.int64)
    capital, small = data - np.uint8(65) < 26, data - np.uint8(97) < 26
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(capital, out=total[1:])
    capitals = total[ends] - total[begins]
    np.cumsum(small, out=total[1:])
    smalls = total[ends] - total[begins]
    title = (capitals == 1) & capital[begins]
    return np.where(capitals == 0, LOWER, np.where(title, TITLE, np.where(smalls == 0, UPPER, OTHER)))


def counted(docs: DataFrame, signs: bool = True) -> DataFrame:
    """word (binary) and n over all texts of docs. Words that begin with a space, which none does, stand for other counts.

    These are ` texts`, ` bytes`, and with `signs` ` case k` and ` pair k`.
    """

    def run(batches):
        seen: Counter = Counter()
        pairs, cases = np.zeros(PAIRS, np.int64), np.zeros(4, np.int64)
        other: Counter = Counter()

        def rows(of: Counter):
            return pa.RecordBatch.from_arrays([pa.array([*of], pa.binary()), pa.array([*of.values()], pa.int64())], names=["word", "n"])

        for batch in by_bytes(batches, limit=SLICE):
            texts = byte_rows(batch.column("text"))
            if signs:
                pairs += pair_counts(texts)
                cases += np.bincount(cases_of(*word_places(texts)), minlength=4)
            other[b" texts"] += len(texts)
            other[b" bytes"] += sum(map(len, texts))
            for t in texts:
                seen.update(words_of(t))
            if len(seen) > FLUSH:
                yield rows(seen)
                seen.clear()
        other.update({b" pair %d" % k: int(pairs[k]) for k in np.flatnonzero(pairs)})
        other.update({b" case %d" % k: int(n) for k, n in enumerate(cases)})
        yield rows(seen)
        yield rows(other)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, distinct: int) -> dict[bytes, int]:
    """The most frequent words, `HEAD` at most: all from the least step of frequency at which they are so few."""
    step = F.floor(F.log2("n") * 8)
    least, have = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 8 steps for each power of two
        have += r["count"]
        if have > HEAD:
            break
        least = r.step
    if least is None:
        return {}
    rows = counts.where(step >= least) if have > HEAD else counts
    return {bytes(r.word): r.n for r in rows.collect()}


class WordModel:
    """What a task needs to hold words against their counts: the head's counts, and the chances of cases and of the signs behind a word."""

    def __init__(self, head: dict[bytes, int], n_words: int, n_texts: int, cases: np.ndarray, pairs: np.ndarray):
        self.head, self.n_words, self.n_texts = head, n_words, n_texts
        behind = pairs.reshape(END + 1, END + 1)[~SPACE].sum(axis=0) * SPACE + SPACE
        self.sign = np.log(np.maximum(behind, 1e-300) / behind.sum())
        chances = (cases + 1.0) / (cases.sum() + 4)
        self.case = np.log(chances)
        self.case[OTHER] = -np.inf  # how such a word is written is not told by its count
        self.share = SHARES[0]

    def held(self, texts: list[bytes], chances: np.ndarray | None):
        """For all words one after the other: word, count, log-chance under the model and by count; words a text; what the model gives all else.

        Without chances all that comes from the model is zero.
        """
        listed = [words_of(t) for t in texts]
        words = [w for own in listed for w in own]
        get = self.head.get
        n = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if chances is None:
            sizes, none = np.array([len(own) for own in listed]), np.zeros(len(words))
            return words, n, none, none, sizes, np.repeat(np.arange(len(texts)), sizes), np.zeros(len(texts))
        data, begins, ends = word_places(texts)
        total = np.concatenate([[0.0], np.cumsum(chances)])
        model = total[ends + 1] - total[begins]
        last = np.cumsum([len(t) + 1 for t in texts])
        sign = data[ends].astype(np.int64)
        sign[np.isin(ends, last - 1)] = END
        count = self.case[cases_of(data, begins, ends)] + self.sign[sign] - math.log(max(1, self.n_words))
        sizes = np.array([len(own) for own in listed])
        of = np.repeat(np.arange(len(texts)), sizes)
        rest = np.diff(total[np.concatenate([[0], last])]) - np.bincount(of, weights=model, minlength=len(texts))
        return words, n, model, count, sizes, of, rest


def averaged(model: np.ndarray, count: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Log of the average of the model's chance and the count's, which has this share; count is the log-chance of a word seen once."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(model + math.log1p(-share), count + np.log(n) + math.log(share))


def fit_share(texts: DataFrame, code: Code, tables: np.ndarray, weights: np.ndarray, words: WordModel) -> float:
    """The best of `SHARES` over all words of these texts; words beyond the head count as unseen here."""
    shared = texts.sparkSession.sparkContext.broadcast((code, tables, weights, words))

    def run(batches):
        own_code, own_tables, own_weights, own = shared.value
        sums = np.zeros(len(SHARES))
        for batch in by_bytes(batches, limit=SLICE):
            listed = byte_rows(batch.column("text"))
            _, n, model, count, *_ = own.held(listed, text_chances(own_code, own_tables, own_weights, listed))
            sums += [averaged(model, count, n, s).sum() for s in SHARES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SHARES))), pa.array(sums)], names=["k", "x"])

    best = texts.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy(F.desc("x"), "k").first()
    return SHARES[best.k] if best is not None else SHARES[0]


RARE = pa.list_(pa.struct([("word", pa.binary()), ("model", pa.float64()), ("count", pa.float64())]))


def score(docs: DataFrame, train: DataFrame, fit: bool = True) -> DataFrame:
    """Every row of docs (as `keyed` gives them, and held_out) under the models of the rows of train; without `fit` under word counts only."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    counts = stored(counted(train, fit))
    special = F.ascii(F.substring(F.col("word"), 1, 1).cast("string")) == 32
    pairs, cases, n_texts, n_bytes = np.zeros(PAIRS, np.int64), np.zeros(4, np.int64), 0, 0
    for r in counts.where(special).collect():  # at most `PAIRS` and a few rows
        name, *at = bytes(r.word).split()
        if name == b"pair":
            pairs[int(at[0])] = r.n
        elif name == b"case":
            cases[int(at[0])] = r.n
        elif name == b"texts":
            n_texts = r.n
        else:
            n_bytes = r.n
    counts = counts.where(~special)
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + n_texts, distinct + (n_texts > 0)
    words = WordModel(head_words(counts, distinct), n_words, n_texts, cases, pairs)
    fitted = None
    if fit:
        code = Code(pairs)
        bits = min(MOST_BITS, max(LEAST_BITS, int(n_bytes).bit_length()))
        tuned = F.pmod(F.xxhash64("doc", "mark"), F.lit(TUNE)) == 0
        tables = fit_tables(train.where(~tuned), code, bits)
        tune = stored(train.where(tuned).select("text"))
        weights = fit_weights(tune, code, tables)
        words.share = fit_share(tune, code, tables, weights, words)
        free(tune)
        fitted = code, tables, weights
    shared = sc.broadcast((fitted, words))

    def run(batches):
        own_fitted, own = shared.value
        for batch in by_bytes(batches, limit=SLICE):
            texts = byte_rows(batch.column("text"))
            chances = text_chances(*own_fitted, texts) if own_fitted else None
            listed, n, model, count, sizes, of, rest = own.held(texts, chances)
            known = n > 0
            mixed_ = averaged(model[known], count[known], n[known], own.share)
            lm = rest + np.bincount(of[known], weights=mixed_, minlength=len(texts))
            base = np.bincount(of[known], weights=np.log10(n[known] + 1), minlength=len(texts)) + math.log10(own.n_texts + 1)
            seen = np.bincount(of[known], minlength=len(texts)) + (own.n_texts > 0)
            rare = np.flatnonzero(~known)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=len(texts)))])
            rows = pa.StructArray.from_arrays([pa.array([listed[i] for i in rare.tolist()], pa.binary()), pa.array(model[rare]), pa.array(count[rare])], fields=list(RARE.value_type))
            cols = [*[batch.column(c) for c in ("doc_id", "doc", "mark", "held_out")], pa.array(sizes + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(lm), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc", "mark", "held_out", "n_tokens", "known", "base", "lm", "n_bytes", "rare"])

    found = stored(docs.select("doc_id", "text", "doc", "mark", "held_out").mapInArrow(run, "doc_id long, doc long, mark long, held_out boolean, n_tokens long, known long, base double, lm double, n_bytes long, rare array<struct<word:binary,model:double,count:double>>"))
    each = found.select("doc", "mark", F.explode("rare").alias("x")).select("doc", "mark", "x.word", "x.model", "x.count").join(counts, "word", "left")
    by_model, by_count = F.col("model") + math.log1p(-words.share), F.col("count") + F.log("n") + math.log(words.share)
    larger, smaller = F.greatest(by_model, by_count), F.least(by_model, by_count)
    mixed_ = F.when(F.col("n").isNull() | (F.col("count") == -math.inf), by_model).otherwise(larger + F.log1p(F.exp(smaller - larger)))
    # equal rows give their words once each, so what is added up here is shared among them
    rare = each.groupBy("doc", "mark").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.count("n").alias("more_known"), F.sum(mixed_).alias("more_lm"), F.count("*").alias("listed"))
    out = found.withColumn("own", F.size("rare")).drop("rare").join(rare, ["doc", "mark"], "left")
    part = lambda c: F.when(F.col("own") > 0, F.col(c) * F.col("own") / F.col("listed")).otherwise(F.lit(0.0))
    score_ = (F.col("lm") + part("more_lm")) / math.log(10)
    by_fit = [score_.alias("score"), F.when(F.col("n_bytes") > 0, -score_ * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")]
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.round(part("more_known"))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + part("more") - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        *(by_fit if fit else []),
    )


def scored(spark: SparkSession, sf_dir: str, fit: bool = True) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("held_out", crc_rest(F.col("doc_id"), 7) == 2)
    return score(docs, docs.where("not held_out"), fit)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op1_mixing` that SQL can express, base scores to four digits; the model, on which they don't hang, is not fitted."""
    return scored(spark, sf_dir, fit=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 4) + 0.0).alias("base_score"))


#: The same in plain SQL. The remainder of crc32 comes from the bits of the id's digits.
BASE_SQL = r"""
with crc as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) as crc
  from (select distinct doc_id from documents)
), words as (
  select d.doc_id, crc % 7 = 2 as held_out, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') || [' '] as w
  from documents d join crc on crc.doc_id = d.doc_id
), tokens as (
  select doc_id, held_out, unnest(w) as w from words
), counts as (
  select w, count(*) as c from tokens where not held_out group by w
), sums as (
  select sum(c)::bigint as n, count(*) as v from counts
)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, n as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) as base_score
from tokens left join counts using (w) cross join sums group by doc_id, held_out, n
"""
