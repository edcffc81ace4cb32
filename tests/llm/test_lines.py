"""Line removal against all pairs of lines."""

import random

import pytest
from twinclock.llm import lines


def plain(rows):
    """rows: (doc, text) with different ids; the removed line numbers of each."""
    every = [(d, k, frozenset(b.split())) for d, t in sorted(rows) for k, b in enumerate((t or "").split("\n"))]
    out = {d: [] for d, _ in rows}
    for n, (d, k, s) in enumerate(every):
        if s and any(9 * len(s & x) >= 4 * (len(s) + len(x)) for _, _, x in every[:n] if x):
            out[d].append(k)
    return out


def check(spark, rows, extra=""):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in lines.remove_lines(docs, keep=("line",)).collect()}
    want = plain(rows)
    assert {d: r.gone for d, r in got.items()} == want
    for d, t in rows:
        parts = (t or "").split("\n")
        assert got[d].kept == "\n".join(p for k, p in enumerate(parts) if k not in set(want[d]))
        assert (got[d].n_lines, got[d].n_removed, got[d].line) == (len(parts), len(want[d]), "x")


@pytest.mark.parametrize("crowd", [1000, 3])
def test_random_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            own.append(" ".join(line))
        rows.append((d, "\n".join(own)))
    check(spark, rows)


@pytest.mark.parametrize("crowd", [1000, 20])
def test_crowd_of_near_copies(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for d in range(150):
        line = list(base)
        line[rng.randrange(30)] = f"own{d}"
        rows.append((d, " ".join(line)))
    check(spark, rows)


def near_copies(n, rng):
    """n lines of thirty words that differ in one word each."""
    out = []
    for d in range(n):
        line = [f"w{k}" for k in range(30)]
        line[rng.randrange(30)] = f"own{d}"
        out.append((d, " ".join(line)))
    return out


@pytest.mark.parametrize("n", [100, 300])
def test_near_copies_are_not_paired(spark, monkeypatch, n):
    """What is held word by word grows with a group of near copies, not with its square."""
    held, whole = [], lines.verified

    def counting(pairs, *more):
        held.append(pairs.count())
        return whole(pairs, *more)

    monkeypatch.setattr(lines, "verified", counting)
    check(spark, near_copies(n, random.Random(5)))
    assert sum(held) <= 4 * n


def test_pairs_are_made_once(spark, monkeypatch):
    """What is verified is a stored table, so that its steps, which read it again and again, do not make the pairs anew."""
    plans, whole = [], lines.verified

    def looking(pairs, *more):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return whole(pairs, *more)

    monkeypatch.setattr(lines, "verified", looking)
    check(spark, near_copies(40, random.Random(6)))
    assert plans and not any("Window" in p or "Generate" in p or "Join" in p for p in plans)


def test_first_words_of_the_smaller_set(spark):
    """Sets that share all but words of the larger one, the larger first and last, at both sides of the least similarity."""
    word = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(word[:50])), (2, " ".join(word[10:50])), (3, " ".join(word[11:50])), (4, " ".join(word[:60])), (5, " ".join(word[1:50:2]))]
    check(spark, rows)
    check(spark, [(9 - d, t) for d, t in rows])


def test_nulls_blanks_and_case(spark):
    check(spark, [(1, None), (2, ""), (3, "a b c\n\n \na  b\tc"), (4, "c b a d"), (5, "\n\n"), (6, "a b c d e"), (7, "x " * 3000 + "\nx")])


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b\nz"), (None, "a b\nz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.gone, r.kept) for r in lines.remove_lines(docs).collect())
    assert got[0] == got[1] and got[2] == got[3]
    assert sorted([got[0][2], got[2][2]]) in (sorted(["z", "a b\nc d"]), sorted(["a b\nz", "c d"]))
    assert lines.remove_lines(docs.limit(0)).count() == 0


def test_long_lines(spark):
    """Lines of more words than a bitmap has bits, at both sides of the least similarity."""
    word = [f"w{k}" for k in range(900)]
    rows = [(1, " ".join(word[:400])), (2, " ".join(word[:500])), (3, " ".join(word[:320])), (4, " ".join(word[80:480])), (5, " ".join(word[44:444]))]
    check(spark, rows)


def test_an_empty_table(spark, tmp_path):
    from twinclock.llm.queries import QUERIES

    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op3_lines"](spark, str(tmp_path)).count() == 0
