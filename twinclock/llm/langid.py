"""Language spans of mixed texts: scripts narrow the candidates, Viterbi labels the words.

A word's score for each language is the log-likelihood of its n-grams of bytes, relative to the best language and floored, so
that no single word decides. Languages that hardly use the word's script in the training texts are no candidates. A
path over a text's words pays a fixed penalty for each switch; the best path gives the spans.

The model is fitted on a bounded sample (`SAMPLE_PER_LANG` labelled documents of each language in expectation, chosen
by a hash of id, text and place); its tables have a fixed number of n-gram buckets. Null texts and texts without letters are `und`
with score 0, as is everything where no labelled text exists. A word in a script that no language uses speaks for none: it takes
its neighbours' label and lowers the score by its share of the text's letters, so a text of such words alone has the first
language by name and score 0. An empty table gives no rows. Repeated rows are labelled one by one; other columns
stay out. Ties go to the language that comes first by name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_rest, scratch_names, table

SAMPLE_PER_LANG = 4000
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FLOOR = -8.0
SWITCH = 14.0
CACHED_WORDS = 100_000
SLICE = 1 << 20  # bytes of text that are labelled at once
WORD = re.compile(r"[^\W\d_]+")
#: First signs of blocks of the code space, by script; signs before the first are Latin.
SCRIPTS = (
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, "indic"), (0xE00, "thai"), (0xE80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
NOWHERE = np.zeros(1, bool)
SCRIPT_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = ("latin", *[n for _, n in SCRIPTS])


def script_of(word: str) -> str:
    if word.isascii():
        return "latin"
    return SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(word[0]))]


def letters(word: str) -> list[str]:
    """The runs of letters in a word; signs such as a superscript two are none."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def words_in(text: str) -> list[str]:
    found = WORD.findall(text)
    return found if all(map(str.isalpha, found)) else [w for x in found for w in letters(x)]


def word_starts(text: str) -> list[int]:
    out = []
    for m in WORD.finditer(text):
        at = 0
        for w in letters(m.group()):
            at = m.group().index(w, at)
            out.append(m.start() + at)
            at += len(w)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams (three bytes, word ends marked, and two), and where each word's begin."""
    x = np.frombuffer(b"\0" + "\0".join(words).lower().encode() + b"\0", np.uint8).astype(np.uint32)
    ends = x == 0
    inside = np.flatnonzero(~ends[1:-1])  # the places before the words' bytes
    three = x[inside] | x[inside + 1] << 8 | x[inside + 2] << 16
    two = x[inside + 1] | x[inside + 2] << 8 | 1 << 24
    both = np.stack([three, two], axis=1).ravel()
    buckets = (both * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return buckets, np.flatnonzero(ends[inside]) * 2


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # bucket by language
    scripts: dict[str, np.ndarray]  # script -> which languages use it

    def __post_init__(self):
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, max(1, len(self.langs))), np.float32)
        self.placed = np.zeros(1024, bool)  # whether any language uses the word's script

    def score(self, words: list[str]) -> np.ndarray:
        """Word by language: log-likelihoods below the best candidate's, not under `FLOOR`."""
        buckets, begins = grams(words)
        own = np.add.reduceat(self.logp[buckets], begins, axis=0)
        none = np.zeros(len(self.langs), bool)
        able = np.array([self.scripts.get(script_of(w), none) for w in words])
        own = np.where(able, own, -np.inf)
        top = own.max(axis=1, keepdims=True)
        return np.where(np.isfinite(top), np.maximum(own - np.where(np.isfinite(top), top, 0), FLOOR), 0).astype(np.float32)

    def numbers(self, words: list[str]) -> list[int]:
        """Rows of `scores` of the words; new words are scored together."""
        get = self.number.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            fresh = [*dict.fromkeys([w for w, n in zip(words, out, strict=True) if n < 0])]
            first = len(self.number)
            self.number.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            while len(self.number) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.placed = np.concatenate([self.placed, np.zeros_like(self.placed)])
            self.scores[first : first + len(fresh)] = self.score(fresh)
            self.placed[first : first + len(fresh)] = [bool(self.scripts.get(script_of(w), NOWHERE).any()) for w in fresh]
            out = [self.number[w] for w in words]
        return out

    def forget(self) -> None:
        if len(self.number) > CACHED_WORDS:
            self.number.clear()


def viterbi(ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word; ids are the texts' words one text after the other. All texts take a step together."""
    n_langs = scores.shape[1]
    kind = np.min_scalar_type(n_langs)
    labels = np.zeros(len(ids), kind)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, long = starts[order], sizes[order]
    came = np.zeros((len(ids), n_langs), kind)
    own = np.arange(n_langs, dtype=kind)
    best = np.zeros((len(sizes), n_langs), np.float32)
    steps = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(steps), side="left")
    for t in range(steps):
        k = active[t]
        now = best[:k]
        at = starts[:k] + t
        if t:
            top = now.argmax(axis=1)
            switched = (now[np.arange(k), top] - penalty)[:, None]
            stay = now >= switched
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, switched)
        best[:k] = now + scores[ids[at]]
    state = best.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]] if t else state[:k]
    return labels


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """The model from labelled rows of docs (columns doc_id, text, lang)."""
    labelled = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    # by the row's place as well, so that rows with one id, or with none, are drawn by themselves
    draw = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(1 << 40))
    sample = labelled.withColumn("draw", draw).where(F.col("draw") < share * (1 << 40))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch in by_bytes(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = words_in(text)
                if words:
                    for w, n in Counter(words).items():
                        scripts.setdefault(lang, Counter())[script_of(w)] += n * len(w)
                    seen[lang] = seen.get(lang, 0) + np.bincount(grams(words)[0], minlength=BUCKETS)
        rows = [(lang, "", g, int(c[g])) for lang, c in seen.items() for g in np.flatnonzero(c).tolist()] + [(lang, s, -1, n) for lang, c in scripts.items() for s, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "script", "bucket", "n"])

    totals = sample.select("text", "lang").mapInArrow(count, "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n"))
    rows = totals.toArrow()  # at most (buckets + scripts) rows a language
    lang, script, bucket, n = (rows.column(c).to_pylist() for c in ("lang", "script", "bucket", "n"))
    langs = sorted(set(lang))
    at = {x: i for i, x in enumerate(langs)}
    table_, used = np.full((BUCKETS, len(langs)), 0.5), {}
    for x, s, b, k in zip(lang, script, bucket, n, strict=True):
        if b >= 0:
            table_[b, at[x]] += k
        else:
            used.setdefault(s, np.zeros(len(langs)))[at[x]] += k
    total = sum(used.values(), np.zeros(len(langs)))
    return Model(langs, np.log(table_ / table_.sum(axis=0)).astype(np.float32), {s: v > 0.001 * np.maximum(total, 1) for s, v in used.items()})


def spans_of(text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) in code points, from the first to the last sign of the text."""
    turns = np.flatnonzero(np.diff(labels)) + 1
    if not len(turns):
        return [(int(labels[0]), 0, len(text))]
    wanted, cuts = set(turns.tolist()), [0]
    cuts += [at for k, at in enumerate(word_starts(text)) if k in wanted] + [len(text)]
    firsts = [int(labels[0]), *labels[turns].tolist()]
    return [(x, a, b) for x, a, b in zip(firsts, cuts[:-1], cuts[1:], strict=True)]


def label(docs: DataFrame, model: Model, penalty: float = SWITCH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred, score (the share of the text in lang_pred's spans, times that of letters in known scripts) and spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, pred, score, spans = scratch_names(docs.select(*keep), "text_", "lang_pred", "score", "spans")
    kept = "text" in keep and docs.schema["text"].dataType.typeName() == "string"  # then the text goes to Python once
    text = "text" if kept else text
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        own = shared.value
        for batch in by_bytes(batches, text, SLICE):
            own.forget()
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [words_in(t) if own.langs else [] for t in texts]
            sizes = [len(w) for w in found]
            words = [w for ws in found for w in ws]
            ids = np.array(own.numbers(words), np.int64)
            labels = viterbi(ids, np.array(sizes), own.scores, penalty)
            of, long = np.repeat(np.arange(len(texts)), sizes), np.fromiter(map(len, words), float, len(words))
            placed = np.bincount(of, weights=long * own.placed[ids], minlength=len(texts)) / np.maximum(1, np.bincount(of, weights=long, minlength=len(texts)))
            out: list[list] = [[], [], []]
            end = 0
            for t, n, known in zip(texts, sizes, placed.tolist(), strict=True):
                start, end = end, end + n
                parts = spans_of(t, labels[start:end]) if n else []
                share: Counter = Counter()
                for x, a, b in parts:
                    share[x] += b - a
                top = min(share, key=lambda x: (-share[x], x), default=None)
                out[0].append("und" if top is None else own.langs[top])
                out[1].append(0.0 if top is None else known * share[top] / len(t))
                out[2].append([{"lang": own.langs[x], "start": a, "stop": b} for x, a, b in parts])
            cols = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], kind)], names=[*keep, pred, score, spans])

    narrow = docs.select(*keep) if kept else docs.select(*keep, F.col("text").cast("string").alias(text))
    schema = docs.select(*keep, F.lit("").alias(pred), F.lit(0.0).alias(score), F.lit(None).cast("array<struct<lang:string,start:int,stop:int>>").alias(spans)).schema
    return narrow.mapInArrow(run, schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    rest = crc_rest(F.col("doc_id"), 4)
    model = fit(docs.where(rest != 2))
    return label(docs, model).select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
