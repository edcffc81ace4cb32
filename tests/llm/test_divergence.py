"""Distances and terms against a plain count in Python and against the SQL, with tiles and corrections of several sizes."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from twinclock.llm import divergence
from twinclock.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, Docs string, whole long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, top=200):
    docs = [((r[2] or ""), (r[3] or ""), terms_of(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 3}
        count = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for d in docs:
            if d[0] == lang:
                count[d[1]].update(t for t in d[2] if t in kept)
        whole = Counter()
        for c in count.values():
            whole.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            own = [("pair", o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in count if o != s]
            more = [("term", t, (shares[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part in (own, more):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(ranked) if x[0] == "pair" or k < top]
    return sorted(out)


def texts(seed, n=120, langs=("en", "de", None), sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Cd", "é", "ß") for b in "qrstuvw"] + ["日本", "x"]
    rows = []
    for i in range(n):
        lang, s = rng.choice(langs), min(rng.randrange(sources), rng.randrange(sources))
        own = rng.choices(words[s : s + 12] + words[:6], k=rng.randrange(0, 40))
        rows.append((i, rng.choice([" ", "\n", "-7,"]).join(own), lang, f"s{s}"))
    return rows


EDGE = [(1, None, "en", "s0"), (2, "", "en", None), (3, "12 !?", "only", "bare"), (4, None, None, None), (5, "one two", "few", "a"), (6, "one", "few", "b"), (None, "x " * 4000 + "é", "en", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 7) for r in rows], SCHEMA)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_like_a_plain_count(spark, tmp_path, monkeypatch):
    rows = texts(1) + EDGE + texts(1)[:3] * 2
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(QUERIES["op12_divergence"](spark, str(tmp_path)))
    assert got == plain(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in con.sql(f"select lang, source, part, item, value, rank from ({divergence.SQL})").fetchall()) == got


@pytest.mark.parametrize(("light", "block", "cells"), [(0, 2, 16), (100, 64, 64), (2, 3, 40)])
def test_any_split(spark, monkeypatch, light, block, cells):
    rows = texts(2)
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "PIECE", 16)
    dense = divergence.dense
    monkeypatch.setattr(divergence, "dense", lambda *x: dense(*x, block=block, cells=cells))
    assert result(divergence.audit(frame(spark, rows), light=light, top=5)) == plain(rows, 5)


def test_nothing(spark):
    assert result(divergence.audit(frame(spark, []))) == []
    assert result(divergence.audit(frame(spark, EDGE[:1]))) == []


def test_large_shares_are_exact():
    rng = random.Random(3)
    whole = [rng.randrange(1, 2**53) for _ in range(200)]
    counts = [rng.randrange(0, w) for w in whole]
    assert divergence.shares(np.array(counts), np.array(whole)).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(counts, whole, strict=True)]
