"""Removed bytes against all windows counted one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from twinclock.llm import suffixes


def plain(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                cover[i : i + span] = True
        kept = bytes(b for b, c in zip(d, cover, strict=False) if not c)
        n_spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0]) if len(d) else 0
        out.append((len(d), int(cover[: len(d)].sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(60) for _ in range(5)]
    texts = [make(rng.randrange(0, 150)) for _ in range(60)]
    texts += [make(20) + rng.choice(passages)[rng.randrange(60) :] + make(20) for _ in range(60)]
    texts += [passages[0][: 199 + k] for k in range(6)] + [None, "", "ab" * 400, "z" * 1000, "z" * 230]
    base = make(120)
    for _ in range(60):  # near copies: neighbourhoods that differ at a common anchor
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice("xyz") + base[k + 1 :])
    return texts + [texts[3], texts[70], texts[70]]


@pytest.mark.parametrize("hot", [2000, 4])
def test_like_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    texts = sample(random.Random(7))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor string").repartition(3)
    want = dict(enumerate(plain([*texts, texts[0], texts[5]], 200)))
    got = suffixes.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = len(texts) if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[i], i


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_range_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 200, 500).astype(np.uint8)
    a = rng.integers(0, 500, 300)
    b = np.minimum(499, a + rng.integers(0, 200, 300))
    assert (suffixes.range_minima(v, a, b) == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]).all()


def test_texts_beyond_the_place_numbers_are_an_error(spark):
    docs = spark.createDataFrame([("x" * 300, 1, 0)], "text string, doc long, mark long")
    assert suffixes.anchors(docs, 200, 301).count() > 0
    with pytest.raises(Exception, match="300 bytes"):
        suffixes.anchors(docs, 200, 300).count()
