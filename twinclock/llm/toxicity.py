"""Toxic documents and the sentences that make them so: sentence scores joined by noisy-or, learned from document labels alone.

A sentence is a run without `.`, `!`, `?` or line ends that holds a word (letters, lower case). It is toxic with p = sigmoid(bias + the
weights of its different words); a word's weight is that of the word and of its beginnings (`STEMS` letters). A document is toxic unless every sentence is clean and the leak (a chance that doesn't hang
on the text, for labels that no sentence explains) doesn't strike: score = 1 - (1 - leak) * prod(1 - p).

The fit sees a bounded sample: at most `SAMPLE` different (id, text) of each label, those with the smallest hashes; the classes are
weighted back to their share among all labelled rows. Words and beginnings are features if they are in `LEAST_DOCS` sampled toxic documents and
stand out there by `LEAST_Z` standard errors, at most `VOCABULARY` of them. The sample's sentences stay in a written table; each of
`ROUNDS` steps sums the gradient of the noisy-or likelihood over it in Spark tasks and moves bias, leak and weights on the driver.

Null and empty texts have no sentence and score the leak, as do texts without words. Rows without a label, or with another than 0 or 1,
and rows without an id teach nothing; an id with both labels teaches both. Without toxic labels all scores are 0, without
clean ones the share of toxic ones is 1 and so is the leak. Repeated rows are scored one by one and taught once. Other columns stay out. An
empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_rest, scratch_names, stored, table

SAMPLE = 20_000
LEAST_DOCS = 5
LEAST_Z = 4.0
VOCABULARY = 1 << 16
STEMS = (4, 5, 6, 7)
CACHED_WORDS = 200_000
ROUNDS = 40
STEP = 0.5
SHRINK = 0.05  # pull of each weight towards 0, a document
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n\r]+")


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -math.inf
    leak: float = 0.0

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.words)}
        self.known: dict[str, float] = {}

    def weigh(self, words: set[str]) -> dict[str, float]:
        """The weights of those words that have any."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = float(sum(self.weights[self.number[f]] for f in traits(w) if f in self.number))
        return {w: x for w in words if (x := known[w])}


def traits(word: str) -> list[str]:
    """The word and its beginnings, with a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """start, stop (code points) and different words of every sentence."""
    out = []
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def chance(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-np.asarray(x, float)))


def noisy_or(p: list[float], leak: float) -> float:
    return -math.expm1(math.fsum(math.log1p(-min(x, 1 - 1e-15)) for x in p) + math.log1p(-min(leak, 1 - 1e-15)))


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """doc, mark, toxic of at most `most` texts of each label, and how many texts bear each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)").distinct()
    marks = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")).where("doc is not null").distinct()
    pool = stored(marks.join(known, "doc").withColumn("draw", F.xxhash64("doc", "mark")))
    counts = {r.toxic: r["count"] for r in pool.groupBy("toxic").count().collect()}
    drawn = [pool.where(F.col("toxic") == y).orderBy("draw", "doc", "mark").limit(most) for y in (0, 1)]
    return drawn[0].unionByName(drawn[1]).drop("draw"), counts


def features(sampled: DataFrame) -> DataFrame:
    """word, toxic, docs: in how many of the sampled texts each word is."""

    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in by_bytes(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[y].update({f for w in set(WORD.findall(text.lower())) for f in traits(w)})
        rows = [(w, y, n) for y, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["word", "toxic", "docs"])

    return sampled.select("text", "toxic").mapInArrow(run, "word string, toxic int, docs long").groupBy("word", "toxic").agg(F.sum("docs").alias("docs"))


def bags(sampled: DataFrame, words: list[str]) -> DataFrame:
    """toxic, others (sentences without a feature), ids and sizes (features of the other sentences, one after the other) of each text."""
    shared = sampled.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        number = shared.value
        for batch in by_bytes(batches):
            others, ids, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                found = [[number[f] for w in sorted(ws) for f in traits(w) if f in number] for _, _, ws in sentences(text)]
                hit = [f for f in found if f]
                others.append(len(found) - len(hit))
                ids.append([x for f in hit for x in f])
                sizes.append([len(f) for f in hit])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(others, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["toxic", "others", "ids", "sizes"])

    return sampled.select("text", "toxic").mapInArrow(run, "toxic int, others long, ids array<int>, sizes array<int>")


def gradient(batch: pa.RecordBatch, weights: np.ndarray, bias: float, leak: float, by_class: tuple[float, float]) -> np.ndarray:
    """Of the weighted negative log-likelihood: by weights, by bias, by the leak's log-odds; last the loss."""
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
    others = batch.column("others").to_numpy(zero_copy_only=False)
    ids, sizes = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "sizes"))
    of_doc = np.repeat(np.arange(len(toxic)), np.diff(batch.column("sizes").offsets.to_numpy()))
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)
    p = chance(bias + np.bincount(of_sentence, weights=weights[ids], minlength=len(sizes)))
    p0 = chance(bias)
    clean = np.log1p(-np.minimum(p, 1 - 1e-12))
    log_clean = np.bincount(of_doc, weights=clean, minlength=len(toxic)) + others * math.log1p(-p0) + math.log1p(-leak)
    score = np.maximum(-np.expm1(log_clean), 1e-12)
    share = np.asarray(by_class)[toxic]
    pull = share * np.where(toxic == 1, 1 - 1 / score, 1.0)  # times p of a sentence: the slope by its log-odds
    by_sentence = pull[of_doc] * p
    out = np.zeros(len(weights) + 3)
    out[:-3] = np.bincount(ids, weights=by_sentence[of_sentence], minlength=len(weights))
    out[-3] = by_sentence.sum() + (pull * others).sum() * p0
    out[-2] = pull.sum() * leak
    out[-1] = -(share * np.where(toxic == 1, np.log(score), log_clean)).sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """The model from texts (doc_id, text) whose ids labels (doc_id, toxic) know."""
    picked, counts = sample_of(docs, labels, most)
    total = sum(counts.values())
    if not counts.get(1) or not counts.get(0):
        return Model(leak=1.0 if counts.get(1) else 0.0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"))
    sampled = texts.join(F.broadcast(picked), ["doc", "mark"])  # at most 2 * `most` rows of three numbers
    sampled = stored(sampled.dropDuplicates(["doc", "mark", "toxic"]).select("text", "toxic"))
    n = {y: min(most, counts[y]) for y in (0, 1)}
    found = features(sampled).groupBy("word").pivot("toxic", [0, 1]).agg(F.sum("docs")).na.fill(0).toDF("word", "clean", "toxic")
    rate = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    z = (F.col("toxic") / n[1] - F.col("clean") / n[0]) / F.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    chosen = found.where(F.col("toxic") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    words = [r.word for r in chosen.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()]
    table_ = stored(bags(sampled, words))
    by_class = tuple(counts[y] / total / n[y] for y in (0, 1))
    state = np.concatenate([np.zeros(len(words)), [-6.0, math.log(max(counts[1] / total, 1e-6) / 2)]])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for k in range(1, rounds + 1):
        weights, bias, leak = state[:-2], float(state[-2]), float(chance(state[-1]))

        def run(batches, weights=weights, bias=bias, leak=leak):
            out = np.zeros(len(weights) + 3)
            for batch in batches:
                if batch.num_rows:
                    out += gradient(batch, weights, bias, leak, by_class)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

        sums = [np.frombuffer(r.g) for r in table_.mapInArrow(run, "g binary").collect()]  # one row a task of a table that SAMPLE bounds
        slope = np.sum(sums, axis=0)[:-1]
        slope[:-2] += SHRINK / (n[0] + n[1]) * weights
        first, second = 0.8 * first + 0.2 * slope, 0.95 * second + 0.05 * slope**2
        state = state - STEP * (first / (1 - 0.8**k)) / (np.sqrt(second / (1 - 0.95**k)) + 1e-9)
    return Model(words, state[:-2], float(state[-2]), float(chance(state[-1])))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """`keep` columns, score and offending of every whole text: start, stop (code points) and p of the sentences with p of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, score_, offending = scratch_names(docs.select(*keep), "text_", "score", "offending")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        own = shared.value
        p0 = float(chance(own.bias))
        for batch in by_bytes(batches, text):
            scores, spans = [], []
            for t in batch.column(text).to_pylist():
                t = t or ""
                lower = t.lower()
                weights = own.weigh(set(WORD.findall(lower)))
                if not weights:
                    plain = sum(1 for m in SENTENCE.finditer(lower) if WORD.search(m.group()))
                    scores.append(-math.expm1(plain * math.log1p(-p0) + math.log1p(-min(own.leak, 1 - 1e-15))))
                    spans.append([])
                    continue
                found = sentences(t)
                p = [float(chance(own.bias + math.fsum(weights.get(w, 0.0) for w in ws))) for _, _, ws in found]
                scores.append(noisy_or(p, own.leak))
                spans.append([{"start": a, "stop": b, "p": x} for (a, b, _), x in zip(found, p, strict=True) if x >= least])
            cols = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*keep, score_, offending])

    narrow = docs.select(*keep, F.col("text").cast("string").alias(text))
    schema = docs.select(*keep, F.lit(0.0).alias(score_), F.lit(None).cast("array<struct<start:int,stop:int,p:double>>").alias(offending)).schema
    return narrow.mapInArrow(run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit(docs, labels.where(crc_rest(F.col("doc_id"), 5) != 0))
    return score(docs, model).select(
        "doc_id", (crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"),
    )
