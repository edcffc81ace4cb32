"""Fingerprints and components against a plain calculation over all pairs."""

import random
import re

import xxhash
from pyspark.sql import functions as F
from twinclock.llm import simhash


def plain_fp(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    ids = [*rows]
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (rows[i] ^ rows[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words_nulls_copies(spark):
    texts = ["The cat Sat on the mat", "the CAT sat\ton the mat ", None, "", " \n", "ÄB c", "one", "x " * 5000, "a b", "a b c d e f g h"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "", "x")], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 11
    assert all(f == f"{plain_fp(texts[i]):016x}" for i, f, _ in got)
    want = plain_components({i: plain_fp(t) for i, t in enumerate(texts)})
    assert all(c == want[i] for i, _, c in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_links_chain_and_crowd(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for k in range(0, 60, 2):  # each two bits from the last
        chain ^= 3 << k
        fps.add(chain)
    core = rng.getrandbits(64)
    for _ in range(400):  # one crowd
        fps.add(core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    rows = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(k,) for k in rows], "fp long")
    from twinclock.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    order = sorted(rows)
    want = plain_components({k: rows[k] for k in order})
    assert {k: roots.get(k, k) for k in order} == want


def test_popcounts(spark):
    vals = [0, -1, 1, 1 << 62, -(1 << 63), 0x0123456789ABCDEF]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vals], "fp long").select(simhash.popcounts(F.col("fp")).alias("v")).collect()]
    assert got == [sum(((v >> 4 * i) & 15).bit_count() << 4 * i for i in range(16)) for v in vals]
