"""Leaks against edit distances over all stretches, and recall of the walks at the full distance."""

import random

from twinclock.llm import leaks


def plain(item, text):
    """The fewest edits over all stretches."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(50)}"
        elif kind == 1:
            out.insert(at, f"more{rng.randrange(50)}")
        elif len(out) > 1:
            out.pop(at)
    return out


def test_against_all_stretches(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]) for k in range(12)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if k % 3:
            own = items[rng.randrange(len(items))][1]
            text[len(text) // 2 : len(text) // 2] = edited(own, rng.randrange(0, 2 + len(own) // 5), rng)
        docs.append((k, text))
    df = spark.createDataFrame([(k, " ".join(t).upper(), 1) for k, t in docs], "doc_id long, text string, leaks int")
    asked = spark.createDataFrame([(k, "\n".join(t)) for k, t in items], "item_id long, text string")
    got = {(r.doc_id, x.item_id, x.edits) for r in leaks.scan(df, asked).collect() for x in r[-1]}
    want = {(d, i, e) for d, t in docs for i, w in items if (e := plain(w, t)) <= len(w) // 5}
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_places_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Ünd so: One two THREE four five six", "c"), (3, "Ünd so: One two THREE four five six", "c"), (None, "one two", None)], "doc_id long, text string, leaks string")
    asked = spark.createDataFrame([(7, "one two three four five"), (8, None), (9, "  "), (7, "one two three four five"), (None, "six")], "item_id long, text string")
    got = leaks.scan(docs, asked, keep=("doc_id", "leaks"))
    assert got.columns == ["doc_id", "leaks", "leaks_"]
    rows = [[(x.item_id, x.start, x.stop, x.edits) for x in r[-1]] for r in got.collect()]
    assert rows == [[], [], [(7, 8, 31, 0), (7, 8, 31, 0), (None, 32, 35, 0)]] + [[(7, 8, 31, 0), (7, 8, 31, 0), (None, 32, 35, 0)], []]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaks.scan(docs, asked).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r[-1] for r in leaks.scan(some, asked.limit(0)).collect()] == [[]]


def test_recall_at_the_full_distance():
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(10, 60)))) for k in range(100)]
    block = leaks.Items(items)
    found = 0
    for k, text in items:
        words = text.split()
        near = " ".join(edited(words, len(words) // 5, rng))
        found += k in [x[0] for x in block.look([f"before it {near} and behind"])[0]]
    assert found >= 97
