"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact verification.

A fingerprint's 16 segments of four bits are mapped to their bit counts. Two fingerprints that differ in d bits
differ by at most d in Manhattan distance between these vectors, so every pair within two bits shares a grid
point that lies within one step of both: each fingerprint enters its own cell and the up to 32 cells beside it.
Cells with few members are verified pair by pair on the real fingerprints. Members of crowded cells meet exactly,
without pairs, at the 65 fingerprints within one bit of each: two fingerprints share one of these if and only
if they differ in at most two bits.

Null texts count as empty; documents without words have fingerprint zero. Rows with the same fingerprint form one
node. Null ids take part but never name a component unless it has no other id. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_rows, cut, table
from .components import components

#: Members of a cell that are compared pair by pair; more go the exact way without pairs.
CROWD = 48


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's word shingles, as a signed integer."""
    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = [*accumulate(map(len, own), lambda a, n: a + 1 + n)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    if len(own) < words:
        hashes = [h(joined, 42)]
    else:
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of these hashes (of 64 bits, one at least), as a signed integer."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long) of every whole text."""

    def run(batches):
        for batch in by_bytes(batches):
            fps = [fingerprint(t, words) for t in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp):
    """Bit counts of the 16 four-bit segments, each in its own four bits of a long."""
    low, high = fp.bitwiseAND(0x5555555555555555), F.shiftrightunsigned(fp, 1).bitwiseAND(0x5555555555555555)
    pairs = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return pairs.bitwiseAND(0x3333333333333333) + F.shiftrightunsigned(pairs, 2).bitwiseAND(0x3333333333333333)


def cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the own grid point and those one step away."""
    v = F.col("v")
    steps = [v]
    for i in range(16):
        part, one = F.shiftrightunsigned(v, 4 * i).bitwiseAND(15), F.lit(1 << 4 * i if i < 15 else 1 << 60).cast("long")
        steps += [F.when(part > 0, v - one), F.when(part < 4, v + one)]
    return fps.select("fp", popcounts(F.col("fp")).alias("v")).select("fp", F.explode(F.array_compact(F.array(*steps))).alias("cell"))


def verified_links(groups: DataFrame) -> DataFrame:
    """Links (a, b) within two bits that connect what is linked in each small cell."""

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for fps in batch.column("fps").to_pylist():
                x = np.array(fps, dtype=np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
                left = np.ones(len(x), dtype=bool)
                for i in range(len(x)):  # a tree over each set of linked members
                    if not left[i]:
                        continue
                    left[i], front = False, [i]
                    while front:
                        k = front.pop()
                        new = np.flatnonzero(near[k] & left)
                        left[new] = False
                        out_a += [fps[k]] * len(new)
                        out_b += [fps[j] for j in new]
                        front += new.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of fingerprints within two bits."""
    at = cells(fps)
    sizes = at.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    few = at.join(sizes.where(F.col("n") <= CROWD), "cell").groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    crowded = at.join(sizes.where(F.col("n") > CROWD), "cell", "left_semi").select("fp").distinct()
    ball = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]))
    met = crowded.select("fp", ball.alias("hub"))
    hubs = met.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    star = met.join(hubs, "hub").where("fp <> a").select("a", F.col("fp").alias("b"))
    return verified_links(few).unionByName(star).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links of at most two bits)."""
    own = cut(fingerprints(docs, words))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
