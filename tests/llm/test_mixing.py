"""The base score against plain sums; the mixed model as a distribution and on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from twinclock.llm import mixing
from twinclock.llm.queries import QUERIES

TEXTS = ["The cat sat on the mat", "the dog\tSAT on a mat\n", None, "", "É the", "a rare Word", "the the the"] * 6 + ["dog eats unseen things " * 400, "\x00 \x01", "mat"]


def plain(rows, i, text):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    seen = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    own = tokens(text)
    return held(i), len(own), sum(seen[w] > 0 for w in own), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own)


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_base(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(mixing, "HEAD", head)
    rows = [*enumerate(TEXTS), (None, "the cat"), (3, ""), (7, TEXTS[7])]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = plain(rows, r.doc_id, dict(rows)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0 and math.isfinite(r.score)


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_base_needs_no_model(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(mixing, "HEAD", head)
    for name in ("fit_tables", "fit_weights", "fit_share", "text_chances"):
        monkeypatch.setattr(mixing, name, None)
    rows = [*enumerate(TEXTS), (None, "the cat"), (3, ""), (7, TEXTS[7])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["unigram_base"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        *want, base = plain(rows, r.doc_id, dict(rows)[r.doc_id])
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == want and abs(r.base_score - base) < 1e-4


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op1_mixing"](spark, str(tmp_path)).count() == 0


def test_nothing_to_learn_from(spark, tmp_path):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    spark.createDataFrame([*zip(held, ["a b", None, "c"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    assert [(r.base_score, r.n_known, r.train_tokens) for r in rows] == [(0.0, 0, 0)] * 3 and all(r.score < 0 for r in rows)


def model(seed=1, bits=16):
    """A code of uneven counts and tables of chance logits."""
    rng = np.random.default_rng(seed)
    code = mixing.Code(rng.integers(0, 50, mixing.PAIRS))
    return code, rng.integers(-60, 60, (mixing.PREDICTORS, 1 << bits)).astype(np.int8), np.tile(mixing.PRIOR_WEIGHTS, (mixing.GATES, 1))


def test_codes_are_complete():
    sizes = model()[0].size.reshape(257, 257)
    assert np.allclose((0.5 ** sizes.astype(float)).sum(axis=1), 1, atol=1e-12) and sizes.max() <= mixing.CODE_BITS


@pytest.mark.parametrize("before", [b"", b"ab", b"abcdefg abcdefg abcdef", b"x" * 40])
def test_next_symbols_add_up_to_one(before):
    """The chances of all signs that may come next, and of the end, are those of one distribution."""
    own = model()
    at = len(before)
    signs = [mixing.log_chances(*own, [before + bytes([c])])[0][at] for c in range(256)]
    end = mixing.log_chances(*own, [before])[0][at]
    assert abs(sum(map(math.exp, [*signs, end])) - 1) < 1e-3


def test_words_chances_add_up_to_one():
    """Over all words and signs behind them, the counts give a share of one at most, and the average keeps that."""
    cases, pairs = np.array([5, 3, 1, 1]), np.random.default_rng(0).integers(0, 9, mixing.PAIRS)
    words = mixing.WordModel({b"a": 3, b"ab": 1}, 4, 1, cases, pairs)
    texts = [w + e for w in (b"a", b"A", b"ab", b"Ab", b"AB") for e in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r", b"")]
    listed, n, model_, count, *_ = words.held(texts, np.zeros(sum(len(t) + 1 for t in texts)))
    assert len(listed) == len(texts)
    total = float((np.exp(count) * n).sum())
    assert 0.7 < total <= 1
    assert mixing.averaged(np.log([0.2]), np.log([0.1]), np.array([3]), 0.5)[0] == pytest.approx(math.log(0.25))


def test_alone_or_together():
    own = model()
    texts = [b"", b"abc " * 500, b"x", "é".encode() * 300, b"Und " * 90]
    together = mixing.log_chances(*own, texts)
    for got, t in zip(together, texts, strict=True):
        assert len(got) == len(t) + 1 and np.allclose(got, mixing.log_chances(*own, [t])[0], rtol=1e-4, atol=1e-5)


def test_parts(monkeypatch):
    own = model()
    whole = mixing.text_chances(*own, [b"ab cd", b"", b"xyz"])
    monkeypatch.setattr(mixing, "PART", 2)
    cut = mixing.text_chances(*own, [b"ab cd", b"", b"xyz"])
    assert len(cut) == len(whole) == 6 + 1 + 4
    assert cut.sum() == pytest.approx(sum(mixing.log_chances(*own, [t])[0].sum() for t in (b"ab", b" c", b"d", b"", b"xy", b"z")))


def test_contexts_see_only_the_past():
    texts = [b"abc def", b"abc dxf"]
    data, starts = mixing.laid_out(texts)
    places, _ = mixing.places_in(starts, texts)
    ctx = mixing.contexts(data, starts, texts)[0].take(places, axis=1)
    assert (ctx[:, 0:6] == ctx[:, 8:14]).all() and (ctx[:, 6] != ctx[:, 14]).all()


def plain_matches(text, order):
    """For each place of a text and its end, what followed the last place with the same bytes before it."""
    seen, out = {}, []
    for i in range(len(text) + 1):
        own = text[max(0, i - order) : i]
        out.append(seen.get(own, -1) if i >= order else -1)
        if i >= order:
            seen[own] = text[i] if i < len(text) else 0
    return out


def test_matches():
    texts = [b"abcdefgh abcdefgx abcdefgx", b"abcdefgh", b"zzzzzzzzzzzz"]
    data, starts = mixing.laid_out(texts)
    places, owner = mixing.places_in(starts, texts)
    guess, state = mixing.matches(data, places, mixing.contexts(data, starts, texts)[1], owner, starts)
    assert guess.tolist() == [x for t in texts for x in plain_matches(t, mixing.MATCH)]
    assert set(state[guess < 0]) == {0} and state.max() >= 1


def test_words_of_a_text():
    data, begins, ends = mixing.word_places([b" The cat\tSAT", b"", b"oN \x0b McX"])
    assert [bytes(data[a:b]) for a, b in zip(begins, ends)] == [b"The", b"cat", b"SAT", b"oN", b"McX"]
    assert mixing.cases_of(data, begins, ends).tolist() == [mixing.TITLE, mixing.LOWER, mixing.UPPER, mixing.OTHER, mixing.OTHER]


def test_equal_rows_and_long_texts(spark, tmp_path, monkeypatch):
    """Repeated rows get what one gets; a long text has a finite score through the registered query."""
    rows = [*enumerate(TEXTS)] * 2 + [(500, "long words of a long text " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_known, round(r.base_score, 6), round(r.score, 4)))
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())


def test_beats_the_base_on_held_out(spark):
    import os

    small = "/root/testdata/sf0.01"
    if not os.path.isdir(small):
        pytest.skip("needs the small tables")
    rows = [r for r in QUERIES["op1_mixing"](spark, small).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
