"""Held-out accuracy on the given table and on planted sentences, noisy-or and its slope against plain versions, edge cases."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from twinclock.llm import toxicity
from twinclock.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
CLEAN = "the house stands by the water and the garden is green while children play near old trees on warm days".split()


def planted(n, seed, first=0):
    """(id, text, toxic, offending sentences): three sentences, one of which may hold a bad word; one label in twenty is wrong."""
    rng, out = random.Random(seed), []
    for i in range(first, first + n):
        parts = [" ".join(rng.choices(CLEAN, k=6)) for _ in range(3)]
        bad = rng.random() < 0.3
        if bad:
            parts[1] += " you " + rng.choice(["vile", "rotten"])
        out.append((i, ". ".join(parts), int(bad != (rng.random() < 0.05)), bad))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], "x", 0.5) for r in rows], "doc_id long, text string, text_ string, score double")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*frames(spark, planted(600, 1)))


def test_finds_sentences_it_was_never_told(spark, model):
    rows = planted(200, 2, 1000)
    docs, _ = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(docs, model, keep=("doc_id", "score", "text_")).select("doc_id", "offending", F.col("score_").alias("s")).collect()}
    assert len(got) == 200
    for i, text, _, bad in rows:
        assert (got[i].s >= 0.5) == bad
        assert [text[o.start : o.stop] for o in got[i].offending] == ([text.split(".")[1]] if bad else [])


def test_noisy_or_of_the_sentences(spark, model):
    text = "A vile house! The garden?\nRotten rotten vile. 12 .. the water" + " the green garden." * 50
    (row,) = toxicity.score(frames(spark, [(1, text, 0)])[0], model, keep=("doc_id",), least=0.0).collect()
    found = toxicity.sentences(text)
    weights = {t: w for t, w in zip(model.words, model.weights, strict=True)}
    p = [1 / (1 + math.exp(-model.bias - sum(weights.get(f, 0) for w in ws for f in toxicity.traits(w)))) for _, _, ws in found]
    assert len(found) == 53 and [text[a:b] for a, b, _ in found][:3] == ["A vile house", " The garden", "Rotten rotten vile"]
    assert row.score == pytest.approx(1 - (1 - model.leak) * math.prod(1 - x for x in p), abs=1e-9)
    assert [o.p for o in row.offending] == pytest.approx(p)


def test_slope():
    rng = np.random.default_rng(4)
    sizes = [[2, 1], [], [3], [1]]
    ids = [rng.integers(0, 5, sum(s)).tolist() for s in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 0, 1], pa.int32()), pa.array([3, 2, 0, 1], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["toxic", "others", "ids", "sizes"])
    w, bias, odds, by = rng.normal(size=5), -1.5, -2.0, (0.7, 1.3)
    sig = lambda x: 1 / (1 + math.exp(-x))
    loss = lambda x: toxicity.gradient(batch, x[:5], x[5], sig(x[6]), by)[-1]
    x = np.array([*w, bias, odds])
    numeric = [(loss(x + h) - loss(x - h)) / 2e-6 for h in np.eye(7) * 1e-6]
    assert toxicity.gradient(batch, w, bias, sig(odds), by)[:-1] == pytest.approx(numeric, rel=1e-4, abs=1e-7)


def test_edges(spark, model):
    long = "the garden " * 200_000 + "you vile"
    rows = [(1, None, 0), (2, "", 0), (3, "12 ?! 34", 0), (4, long, 0), (4, long, 0), (None, "you rotten", 0)]
    docs, labels = frames(spark, rows)
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    assert [s for i, s in got if i in (1, 2, 3)] == pytest.approx([model.leak] * 3)
    assert all(s > 0.5 for i, s in got if i in (4, None))
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0] * 6
    assert toxicity.fit(docs, labels.withColumn("toxic", F.lit(1))).leak == 1.0
    assert toxicity.fit(docs.limit(0), labels).leak == 0.0
    odd = labels.withColumn("toxic", F.when(F.col("doc_id") == 4, 7))
    assert toxicity.sample_of(docs, odd)[0].count() == 0


def test_sample_is_bounded(spark):
    rows = [(i % 7, f"text {i}", 0) for i in range(300)] + [(None, f"t {i}", 1) for i in range(300)] + [(900, "same", 1)] * 50
    docs, labels = frames(spark, rows)
    picked, counts = toxicity.sample_of(docs, labels, 20)
    n = {r.toxic: r["count"] for r in picked.groupBy("toxic").count().collect()}
    assert n == {0: 20, 1: 1} and counts == {0: 300, 1: 1}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_held_out(spark):
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op11_toxicity"](spark, SMALL)
    rows = got.join(truth, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held) > 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
