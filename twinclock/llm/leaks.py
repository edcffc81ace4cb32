"""Benchmark decontamination by random-walk embedding, bit sampling and exact edit distance.

Texts and benchmark items are sequences of words (lower case). An item of n words leaks into a text if some stretch of the
text is within `n // SLACK` word edits of it. For windows of an item's size at every word, a CGK random walk maps edit distance
to Hamming distance: the walk writes the word it stands on and goes on by a coin that depends on step and word. Windows
meet items that agree at a few sampled steps; `WALKS` walks of `SAMPLES` samples each are repeated, so that a window at the
full edit distance is met with a probability of about `1 - 1e-3`. What meets is verified by edit distance on the words.

Most windows can't match at all: of k + 1 pieces of an item, k edits leave one intact. Only windows of an item's size that
may hold such a piece (of any item of that size) at its place are embedded; that loses nothing.

Items are taken in blocks of about `BLOCK`; a block is what is broadcast. Null texts and items, and those without words, never
match. Repeated rows are scanned one by one, repeated items are reported each. Of several places, the one with the
fewest edits is reported, then the first. Extra columns stay out unless asked for.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, scratch_names, table
from .suffixes import mixed

SLACK = 5
WALKS, SAMPLES, STEPS = 6, 12, 3
LONGEST_GRAM = 4
BLOCK = 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MATCHES = "array<struct<item_id:bigint,start:int,stop:int,edits:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def gram_codes(ids: np.ndarray, g: int) -> np.ndarray:
    """A number for each run of g words; runs with an unknown word get one that stands for none."""
    out, known = np.zeros(len(ids) - g + 1, np.int64), np.ones(len(ids) - g + 1, bool)
    for k in range(g):
        own = ids[k : len(ids) - g + 1 + k]
        out = out * 0x5851F42D4C957F2D + own
        known &= own > 0
    return np.where(known, out, -1)


def sampled_keys(windows: np.ndarray) -> np.ndarray:
    """Keys (window by sample) of rows of symbols; 0 is a word that no item has, and what stands after the end.

    All walks go on together; a walk's coin at a step is a bit of the symbol's hash.
    """
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), windows.dtype)], axis=1).astype(np.uint64)
    rng = np.random.default_rng(n)
    reach = max(1, 2 * n - 1)
    flat = np.tile(padded.ravel(), WALKS)
    base = (np.arange(WALKS * rows) * (n + 1)).reshape(WALKS, rows)
    place = np.zeros((WALKS, rows), np.int64)
    walked = np.empty((reach, WALKS, rows), np.uint64)
    walk = np.repeat(np.arange(WALKS, dtype=np.uint64), rows * (n + 1))
    for step in range(reach):
        if step % 64 == 0:
            coins = mixed(flat * np.uint64(0x9E3779B97F4A7C15) + walk * np.uint64(100_003) + np.uint64(step + 1))
        at = base + place
        np.take(flat, at, out=walked[step])
        place += (np.take(coins, at) >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64)
        np.minimum(place, n, out=place)
    picks = rng.choice(reach, (WALKS, SAMPLES, STEPS))
    keys = np.tile(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64).reshape(WALKS, SAMPLES, 1), (1, 1, rows))
    own = np.arange(WALKS)[:, None]
    for k in range(STEPS):
        keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + walked[picks[:, :, k], own])
    return keys.reshape(WALKS * SAMPLES, rows).T


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text that is nearest to the item; the first end on ties, then the shortest."""
    def rows(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, x in enumerate(a.tolist(), 1):
            new = np.minimum(row + 1, i + steps * 0 + len(a) + len(b))
            new[1:] = np.minimum(new[1:], row[:-1] + (b != x))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = rows(item, text, True)
    end = int(row.argmin())
    back = rows(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        words = [(i, words_of(t)) for i, t in rows]
        words = [(i, w) for i, w in words if w]
        self.number = {w: k for k, w in enumerate(sorted({x for _, w in words for x in w}), 1)}
        self.ids = [i for i, _ in words]
        self.items = [np.array([self.number[x] for x in w], np.int64) for _, w in words]
        self.base = len(self.number) + 1
        #: by a gram's size: its sorted codes, and for each the sizes of items and places in them where it is a piece
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        made: dict[int, set[tuple[int, int, int]]] = {}
        for x in self.items:
            n = len(x)
            parts = n // SLACK + 1
            for k in range(parts):
                a, b = k * n // parts, (k + 1) * n // parts
                b = min(b, a + LONGEST_GRAM)
                made.setdefault(b - a, set()).add((int(gram_codes(x[a:b], b - a)[0]), n, a))
        for g, own in made.items():
            codes, n, a = np.array(sorted(own), np.int64).T
            self.grams[g] = codes, n, a
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(x) for x in self.items])
        for n in sorted({*sizes.tolist()}):
            own = np.flatnonzero(sizes == n)
            keys = sampled_keys(np.stack([self.items[k] for k in own])).ravel()
            order = np.argsort(keys, kind="stable")
            self.by_size[n] = keys[order], np.repeat(own, WALKS * SAMPLES)[order]

    def windows(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(size, starts) of the windows of ids that may match an item of that size: those that may hold an intact piece."""
        out: dict[int, list[np.ndarray]] = {}
        for g, (codes, sizes, offsets) in self.grams.items():
            if len(ids) < g:
                continue
            own = gram_codes(ids, g)
            low = np.searchsorted(codes, own)
            hit = np.flatnonzero(codes[np.minimum(low, len(codes) - 1)] == own)
            if not len(hit):
                continue
            high = np.searchsorted(codes, own[hit], side="right")
            for i, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for n, offset in zip(sizes[a:b].tolist(), offsets[a:b].tolist(), strict=True):
                    k = n // SLACK
                    out.setdefault(n, []).append(np.arange(max(0, i - offset - k), max(0, i - offset + k) + 1))
        return [(n, np.unique(np.concatenate(s))) for n, s in out.items()]

    def look(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text (item id, start, stop, edits) of every item that leaks into it, in code points.

        All texts' words stand in one array, an unknown word behind each text.
        """
        get, none = self.number.get, np.zeros(1, np.int64)
        own = [np.fromiter(map(get, words_of(t), repeat(0)), np.int64) for t in texts]
        sizes = np.array([len(x) for x in own])
        ends = np.cumsum(sizes + 1)
        ids = np.concatenate([p for x in own for p in (x, none)]) if own else none
        met: list[dict[int, set[int]]] = [{} for _ in texts]
        for n, start in self.windows(ids):
            keys, owner = self.by_size[n]
            row = np.searchsorted(ends, start, side="right")
            start, row = start[row < len(ends)], row[row < len(ends)]
            padded = np.concatenate([ids, np.zeros(n, np.int64)])
            for low in range(0, len(row), 1 << 14):
                wanted = sampled_keys(padded[start[low : low + (1 << 14), None] + np.arange(n)])
                a, b = np.searchsorted(keys, wanted.ravel()), np.searchsorted(keys, wanted.ravel(), side="right")
                for k in np.flatnonzero(b > a).tolist():
                    at = low + k // wanted.shape[1]
                    for item in set(owner[a[k] : b[k]].tolist()):
                        met[row[at]].setdefault(item, set()).add(int(start[at] - (ends[row[at]] - sizes[row[at]] - 1)))
        return [self.verify(t, x, m) if m else [] for t, x, m in zip(texts, own, met, strict=True)]

    def verify(self, text: str, ids: np.ndarray, met: dict[int, set[int]]) -> list[tuple[int | None, int, int, int]]:
        found = []
        for item, places in met.items():
            own = self.items[item]
            n, k = len(own), len(own) // SLACK
            best, left = (k + 1, 0, 0), sorted(places)
            if (exact := next((p for p in left if np.array_equal(ids[p : p + n], own)), None)) is not None:
                best, left = (0, exact, exact + n), []
            while left:  # places whose surroundings overlap are verified together
                a, b, used = max(0, left[0] - k), left[0], 0
                while used < len(left) and left[used] <= b + n:
                    b = left[used]
                    used += 1
                left = left[used:]
                edits, s, e = nearest(own, ids[a : b + n + 2 * k])
                if edits <= k and e > s:
                    best = min(best, (edits, a + s, a + e))
            if best[0] <= k:
                found.append((self.ids[item], *best[1:], best[0]))
        if not found:
            return []
        ends = [m.span() for m in WORD.finditer(text)]
        return sorted(((i, ends[s][0], ends[e - 1][1], edits) for i, s, e, edits in found), key=lambda x: (x[1], x[2], x[0] is None, x[0] or 0))


def scan(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and, last, the leaks of every whole text: an array of item_id, start, stop (code points) and edits."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    text, matches = scratch_names(docs.select(*keep), "text_", "leaks")
    out = docs.select(*keep, F.col("text").cast("string").alias(text), F.array().cast(MATCHES).alias(matches))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # a block
        shared = spark.sparkContext.broadcast(Items(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))))
        out = out.mapInArrow(scanner(shared, text, matches), out.schema)
    return out.drop(text)


def scanner(shared, text: str, matches: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        items = shared.value
        for batch in by_bytes(batches, text):
            at = batch.schema.get_field_index(matches)
            found = []
            for own, before in zip(items.look([t or "" for t in batch.column(text).to_pylist()]), batch.column(at).to_pylist(), strict=True):
                found.append((before or []) + [dict(zip(("item_id", "start", "stop", "edits"), x, strict=True)) for x in own])
            cols = [pa.array(found, kind) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start", "x.stop", "x.edits")
