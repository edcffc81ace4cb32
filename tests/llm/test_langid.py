"""Held-out accuracy on the given table, the best path against a search over all paths, and edge cases."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.llm import langid
from twinclock.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_held_out(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_langid"](spark, SMALL)
    rows = got.join(truth, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert sum(r.ok for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert got.count() == truth.count()


def test_best_path():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 5, 1, 6, 3])
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    ids = rng.integers(0, 9, sizes.sum())
    labels = langid.viterbi(ids, sizes, scores, 2.0)
    at = 0
    for n in sizes:
        own, path = ids[at : at + n], labels[at : at + n]
        value = lambda p: sum(scores[i, x] for i, x in zip(own, p, strict=True)) - 2 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert n == 0 or value(path) >= max(value(p) for p in itertools.product(range(3), repeat=int(n))) - 1e-4
        at += n


def test_mixed_null_and_scripts(spark):
    en = "the house and the garden of the king with the water"
    ru = "дом и сад короля у воды на берегу реки"
    rows = [(i, (en if i % 2 else ru) + f" {i}", "en" if i % 2 else "ru", "x") for i in range(40)]
    extra = [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 !?", "en", "x"), (103, f"{en} {en} {ru} {ru}", None, "x"), (103, "дом", None, "x"), (None, en, None, "x"), (104, en * 2000, None, "x")]
    extra += [(105, "½ ²", None, "x"), (106, "日本語の文章です", None, "x"), (107, f"{en} m² 日本語", None, "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, text_ string")
    got = {}
    for r in langid.label(docs, langid.fit(docs), keep=("doc_id", "text_")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100][0].score == 0
    assert [got[i][0].lang_pred for i in (1, 2, 104, None)] == ["en", "ru", "en", "en"]
    assert (got[105][0].lang_pred, got[105][0].score) == ("und", 0)
    assert got[106][0].score == 0 and got[106][0].lang_pred in ("en", "ru")
    assert got[107][0].lang_pred == "en" and 0.8 < got[107][0].score < 1
    mixed = next(r for r in got[103] if len(r.spans) > 1)
    assert [s.lang for s in mixed.spans] == ["en", "ru"] and mixed.spans[0].stop == mixed.spans[1].start == len(f"{en} {en} ")
    assert [r.lang_pred for r in langid.label(docs, langid.fit(docs.limit(0))).where("doc_id = 1").collect()] == ["und"]
    assert langid.label(docs.limit(0), langid.fit(docs)).count() == 0


def test_words_are_letters():
    text = "aⅧb m² x_y ½"
    assert langid.words_in(text) == ["a", "b", "m", "x", "y"]
    assert [text[i] for i in langid.word_starts(text)] == ["a", "b", "m", "x", "y"]


def test_many_languages():
    """More languages than a byte counts."""
    ids, scores = np.array([0, 1, 0]), np.full((2, 300), -8, np.float32)
    scores[0, 290] = scores[1, 290] = 0
    assert langid.viterbi(ids, np.array([3]), scores, 14.0).tolist() == [290] * 3


def test_word_scores():
    """Log-likelihoods of a word's n-grams against sums over the model's table, floored below the best language's."""
    rng = np.random.default_rng(4)
    own = langid.Model(["a", "b", "c"], np.log(rng.random((langid.BUCKETS, 3))).astype(np.float32), {"latin": np.array([True, True, False])})
    for word in ("a", "tree", "Élan"):
        x = b"\0" + word.lower().encode() + b"\0"
        codes = [c for k in range(len(x) - 2) for c in (int.from_bytes(x[k : k + 3], "little"), int.from_bytes(x[k + 1 : k + 3], "little") | 1 << 24)]
        at = [(c * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BUCKET_BITS for c in codes]
        sums = own.logp[at].astype(float).sum(axis=0)[:2]
        want = [max(s - sums.max(), langid.FLOOR) for s in sums] + [langid.FLOOR]
        assert np.allclose(own.score([word])[0], want, atol=1e-3)


def test_registered_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op8_langid"](spark, str(tmp_path)).count() == 0


def test_sample_of_rows_without_an_id(spark, monkeypatch):
    """A bound holds for them as for others: fits on 40 of 4,000 equal rows and on all of them see the same languages, not the same counts."""
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the house by the water").alias("text"), F.lit("en").alias("lang"))
    held = []
    monkeypatch.setattr(langid, "Model", lambda langs, logp, scripts: held.append((langs, logp)))
    langid.fit(rows, 40)
    langid.fit(rows)
    (few, small), (all_, large) = held
    top = lambda logp: float(np.exp(logp[:, 0].max() - logp[:, 0].min()))  # noqa: E731  counts above the half that stands for none
    assert few == all_ == ["en"] and 10 * top(small) < top(large)
