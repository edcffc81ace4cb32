"""Digests, proofs and verdicts against a plain tree in Python; the SQL is held against the query by the driver and here on edge cases."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from twinclock.llm import merkle
from twinclock.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int, Idx int, PATH string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """The root of the nodes and, for each of them, (left, right) siblings of every level."""
    own, paths = list(nodes), [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(own) > 1:
        for k, p in enumerate(paths):
            run = own[at[k] // 3 * 3 : at[k] // 3 * 3 + 3]
            p.append(("".join(run[: at[k] % 3]), "".join(run[at[k] % 3 + 1 :])))
            at[k] //= 3
        own = [h(*own[i : i + 3]) for i in range(0, len(own), 3)]
    return own[0] if own else None, paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[3] is None else "=" + r[3], []).append(r)
    keys = sorted(groups, key=lambda s: s.encode())
    trees = {}
    for g in keys:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees[g] = own, *grow([leaf(*r[:5]) for r in own])
    root, above = grow([trees[g][1] for g in keys])
    out = []
    for g, up in zip(keys, above, strict=True):
        for r, path in zip(trees[g][0], trees[g][2], strict=True):
            text = r[1]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            d = leaf(r[0], text, *r[2:5])
            for a, b in path + up:
                d = h(a, d, b)
            out.append((r[0], leaf(*r[:5]), trees[g][1], root, h(*[x for ab in path + up for x in ab]), d, d == root))
    return sorted(out, key=str)


def run(spark, where, rows):
    spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    got = QUERIES["op13_manifest"](spark, str(where))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


ROWS = [(i, f"line {i}\nend\n" if i % 3 else f"line {i}", "en", f"s{i % 4 % 3}", i) for i in range(90)]
EDGE = [(500, None, None, None, None), (501, "", "", "", 0), (None, "a\nb", "de", "s1", 3), (None, None, "de", "s1", 3), (7, "other\n", "en", "s1", 1), (503, "ÄÖ\n" * 5000, "é", "źródło", 2), (504, "x\n", "en", "lone", 2)]


def test_like_a_plain_tree(spark, tmp_path):
    rows = ROWS + EDGE + ROWS[:5] + ROWS[:1] * 40
    got = run(spark, tmp_path, rows)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False} and len(got) == len(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((tuple(r) for r in con.sql(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({merkle.SQL})").fetchall()), key=str) == got


@pytest.mark.parametrize("rows", [[], EDGE[:1], EDGE[:2], ROWS[:3] * 2, [(i, "t", "en", "one", 1) for i in range(10)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


def test_a_group_spreads_over_ranges(spark):
    rows = spark.range(3000).select(F.lit("=hot").alias("grp"), F.lit(1).alias("key"), F.lit("d").alias("digest"))
    out = merkle.placed(rows.repartition(4), ["key", "digest"])
    assert sorted(r.idx for r in out.collect()) == list(range(3000)) and out.select("n").distinct().collect()[0].n == 3000
