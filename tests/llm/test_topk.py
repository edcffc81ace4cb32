"""Every query's best ten against a full scan."""

import math

import numpy as np
from twinclock.llm import topk
from twinclock.llm.queries import QUERIES


def plain(rows, k=10):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in own if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in own if (i, w) != (q, list(v)) and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op10_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())


def test_like_a_full_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 700)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 12)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(2500)]
    rows += [(3000 + i, rows[0][1]) for i in range(50)]  # ties
    rows += [(200, rows[4][1]), (7, rows[9][1])]  # ids with a second vector
    rows += [(700, None), (None, [1.0] * 8), (800, [float("nan")] * 8), (900, [None] * 8), (1000, []), (1100, [float("inf")] * 8), (100, [1.0, 2.0]), (5, [3.0, 1.0]), (7, rows[7][1])]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_few_and_none(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
    assert run(spark, tmp_path / "b", []) == []
    assert run(spark, tmp_path / "c", [(1, [1.0])]) == []
