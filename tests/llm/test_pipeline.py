"""Stages of the corpus pipeline against plain versions."""

import random

import corpus_pipeline


def plain_near_dedup(rows):
    """Ids that stay, equal rows once: all pairs by Jaccard similarity of their five-word shingles, groups by links."""
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    group = {i: i for i, _ in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return sorted(i for i in group if find(i) == i)


def near_texts(rng, n):
    """Texts of all degrees of similarity: copies with some words changed at one place or at many, and a passage that many share."""
    vocab = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocab, k=40)
    made = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and made:
            w = list(rng.choice(made))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.4:
                w += rng.choices(vocab, k=rng.randrange(1, 2 + len(w) // 3))
        else:
            w = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 9, 30, 60, 120]))
            if kind > 0.8:
                w = w[:30] + passage + w[30:]
        made.append(w)
    return [" ".join(w) for w in made]


def test_near_dedup_like_all_pairs(spark):
    rng = random.Random(5)
    rows = [*enumerate([*near_texts(rng, 400), "", None, " \n", "One two", "one  TWO", "one two three"])]
    rows.append(rows[20])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == plain_near_dedup(rows)


def test_near_dedup_of_one_id_with_two_texts(spark):
    rows = [(1, "one two three"), (1, "four five six"), (1, "four five six"), (None, "four five six"), (None, "seven"), (None, "seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert [g for g in got if g[1] != "four five six"] == [(0, "seven"), (1, "one two three")] and len(got) == 3
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_at_the_bound(spark):
    """100 shared shingles of 125 are alike, of 126 not; another word in the middle of a copy changes many bits of a SimHash."""
    word = [f"v{k}" for k in range(400)]
    alike = [" ".join(word[:104]), " ".join(word[:129])]
    unlike = [" ".join(word[200:304]), " ".join(word[200:330])]
    changed = [" ".join(f"u{k}" for k in range(150)), " ".join(f"u{k}" if k not in (40, 90) else "new" for k in range(150))]
    docs = spark.createDataFrame([*enumerate([*alike, *unlike, *changed])], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3, 4]


def test_near_dedup_of_a_crowd(spark):
    rng = random.Random(6)
    base = [f"c{k}" for k in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(100)] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == plain_near_dedup(rows)


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """Without the exact join, near copies within two bits are still found, and what is that near without being similar is not."""
    from twinclock.llm import copies, simhash

    none = lambda *_: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(copies, "first_meetings", none)
    monkeypatch.setattr(copies, "all_meetings", none)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(3000)]
    rows, sets = [], []
    for i in range(40):
        w = base[: 3000 - 2 * (i % 20)] if i < 20 else [rng.choice(base) for _ in range(50)]
        rows.append((i, " ".join(w)))
        sets.append(copies.shingles(rows[-1][1].encode(), 5))
    fps = [simhash.majority(s) for s in sets]
    group = [*range(40)]
    for i in range(40):
        for j in range(40):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and 9 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 4 * (len(sets[i]) + len(sets[j])):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    want = [i for i in range(40) if group[i] == i]
    assert len(want) < 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
