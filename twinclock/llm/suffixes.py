"""Removal of repeated byte strings by a column-wise multi-document suffix order.

Every window of `span` bytes picks its least q-gram by a hash (the last one on ties) as its anchor. The choice depends on
the window's bytes alone, so equal windows pick the same anchor at the same distance: all places where a window can
repeat are found by joining on the anchor. The neighbourhoods of one anchor (all windows over it: up to span - q bytes
to the left, span to the right) are the documents of a small collection. Their suffix order is built column by column
from the right: each round inserts one symbol per document, carries the order over by a stable distribution on the new
symbol, and derives the common prefix of neighbours from range minima of the last column's. A window repeats where a
common prefix reaches `span` bytes. Columns are read in sequence, and only the last order and prefixes are kept.

Equal neighbourhoods enter once with their number; those alone at their anchor need no order, as their number answers.
Anchors with many different neighbourhoods are split into blocks of windows that share all but a few bytes (`CUTS`), so
that a common anchor spreads by the content around it.

Texts are UTF-8 bytes; null is empty. Matches never cross documents. Rows with equal id and text are repeats of each other
and get equal results; rows without an id are known by their text. An empty table gives no rows. A text of 2 ** `PLACE_BITS` bytes or
more is an error.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_rows, cut, table

Q = 32
PLACE_BITS = 28  # a text's bytes are numbered in so many bits
HOT = 2000  # different neighbourhoods from which an anchor is split
CUTS = 8
BUCKET = 8000  # neighbourhoods that a task orders at once, on average
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd
MASK = (1 << 64) - 1


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Hashes of any byte range of one array."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        up, self.down = powers(base, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


def anchors_in(data: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, Prefix]:
    """Places of the anchors of all windows that lie within one text, and the hashes of all q-grams."""
    wide = span - Q + 1
    if len(data) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64), None
    own = Prefix(data, BASE)
    n = len(data) - Q + 1
    grams = mixed((own.sums[Q:] - own.sums[:-Q]) * own.down[:n])
    keys = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | (np.uint64((1 << PLACE_BITS) - 1) - np.arange(n, dtype=np.uint64))
    rows = -(-n // wide)
    held = np.full(rows * wide, MASK, np.uint64)
    held[:n] = keys
    held = held.reshape(rows, wide)
    ahead = np.minimum.accumulate(held, axis=1).ravel()
    behind = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - wide + 1)
    least = np.minimum(behind[starts], ahead[starts + wide - 1])
    ends = np.cumsum(sizes)
    inside = np.ones(len(starts), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - span + 1) : e] = False
    places = (1 << PLACE_BITS) - 1 - (least[inside] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return np.unique(places), grams, own


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, text (never null), doc (the id, or the text's hash where it is null) and mark (36 bits of the text's hash)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.xxhash64("text")), "mark": F.shiftrightunsigned(F.xxhash64("text"), PLACE_BITS)})


def anchors(docs: DataFrame, span: int, longest: int = 1 << PLACE_BITS) -> DataFrame:
    """anchor, around (hash of its neighbourhood), doc, at (mark and place) of every anchor; docs as `keyed` gives them."""

    def run(batches):
        for batch in by_bytes(batches, limit=2 << 20):
            texts = byte_rows(batch.column("text"))
            sizes = np.array([len(t) for t in texts])
            if sizes.max() >= longest:
                raise ValueError(f"a text of {sizes.max()} bytes; places are known below {longest}")
            data = np.frombuffer(b"".join(texts), np.uint8)
            places, grams, own = anchors_in(data, sizes, span)
            if not len(places):
                continue
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, places, side="right")
            first, last = (ends - sizes)[text], ends[text]
            left, right = np.maximum(first, places - (span - Q)), np.minimum(last, places + span)
            other = Prefix(data, BASE2)
            around = mixed(own.of(left, right) ^ mixed(other.of(left, right) + (places - left).astype(np.uint64) * np.uint64(4096) + (right - places).astype(np.uint64)))
            doc, mark = batch.column("doc").to_numpy()[text], batch.column("mark").to_numpy()[text]
            at = mark << PLACE_BITS | (places - first)
            yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(at)], names=["anchor", "around", "doc", "at"])

    return docs.select("text", "doc", "mark").mapInArrow(run, "anchor long, around long, doc long, at long")


def repeated_windows(strings: np.ndarray, span: int) -> np.ndarray:
    """Which windows of `span` symbols of each row repeat at the same column of another row.

    strings: rows of symbols, 256 for none. Column by column from the right, the order of the rows' suffixes and the
    neighbours' common prefixes (no longer than span) are carried over.
    """
    rows, columns = strings.shape
    found = np.zeros((columns, rows), bool)
    order, common = np.arange(rows), np.zeros(rows, np.uint8)
    by_column = np.ascontiguousarray(strings.T)
    for j in range(columns - 1, -1, -1):
        symbols = by_column[j][order]
        come = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[come]
        same = (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] < 256)
        a, b = come[:-1][same] + 1, come[1:][same]
        fresh = np.zeros(rows, np.uint8)
        if len(a):
            fresh[1:][same] = np.minimum(range_minima(common, a, b), span - 1) + 1
        order, common = order[come], fresh
        full = common >= span
        if full.any():
            hit = np.flatnonzero(full)
            found[j, order[hit]] = found[j, order[hit - 1]] = True
    return found.T


def range_minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a .. b]) for each pair, ends included, by minima of ranges of powers of two."""
    long = b - a + 1
    level = np.frexp(long)[1] - 1
    out = np.empty(len(a), values.dtype)
    now, width = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            now = np.minimum(now[:-width], now[width:])
            width *= 2
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(now[a[at]], now[b[at] - width + 1])
    return out


def runs(found: np.ndarray, span: int) -> list[list[tuple[int, int]]]:
    """For each row, the ranges that its repeated windows cover, by first window."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    for (r, s), (_, e) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True):
        out[r].append((int(s), int(e) - 1 + span))
    return out


def neighbourhoods(wanted: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """(anchor, around, part, key, body, n): the bytes around each wanted anchor, one row a part.

    wanted: anchor, around, doc, at, n, hot. A whole neighbourhood is part -1 under its anchor. Those of hot anchors come in
    `CUTS` parts, each the windows that start in one range; its key is the hash of what all these windows share.
    """
    per_doc = wanted.select("doc", F.shiftrightunsigned("at", PLACE_BITS).alias("mark"), F.struct("anchor", "around", F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"), "n", "hot").alias("w"))
    per_doc = per_doc.groupBy("doc", "mark").agg(F.collect_list("w").alias("wanted"))
    left, step = span - Q, -(-(span - Q + 1) // CUTS)

    def run(batches):
        import xxhash

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, wanted_here in zip(byte_rows(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted_here:
                    p = w["place"]
                    if w["hot"]:
                        # windows that start in [s, e] share [e, s + span); where one of them lies in the text, so does that
                        parts = []
                        for k in range(CUTS):
                            s, e = p - left + k * step, min(p - left + (k + 1) * step - 1, p)
                            if max(s, 0) <= min(e, len(text) - span):
                                parts.append((k, xxhash.xxh3_64_intdigest(text[e : s + span]) - (1 << 63), s, e + span))
                    else:
                        parts = [(-1, w["anchor"], p - left, p + span)]
                    for k, key, s, e in parts:
                        body = text[max(0, s) : e]
                        for col, x in zip(out, (w["anchor"], w["around"], k, key, bytes([max(0, -s)]) + body, w["n"]), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["anchor", "around", "part", "key", "body", "n"])

    joined = docs.select("doc", "mark", "text").join(per_doc, ["doc", "mark"]).select("text", "wanted")
    return joined.mapInArrow(run, "anchor long, around long, part int, key long, body binary, n long")


def ordered(parts: DataFrame, span: int) -> DataFrame:
    """anchor, around, spans (array of start and end, relative to the anchor): what repeats around each anchor.

    Parts with hot anchors are first brought down to different strings, so that a task never gets a common string more than once.
    """
    left, step = span - Q, -(-(span - Q + 1) // CUTS)
    parts = parts.withColumn("own", F.xxhash64("body"))
    strings = parts.where("part >= 0").groupBy("part", "key", "own", "body").agg(F.sum("n").alias("n"))
    whole = parts.where("part < 0")
    buckets = max(1, -(-parts.count() // BUCKET))

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        width = left + span if part < 0 else step - 1 + span
        bodies = group.column("body").to_pylist()
        strings = np.full((len(bodies), width), 256, np.uint16)
        for row, body in zip(strings, bodies, strict=True):
            row[body[0] : body[0] + len(body) - 1] = np.frombuffer(body, np.uint8, offset=1)
        found = repeated_windows(strings, span)
        for k in np.flatnonzero(group.column("n").to_numpy() > 1).tolist():
            found[k, bodies[k][0] : max(bodies[k][0], bodies[k][0] + len(bodies[k]) - span)] = True
        base = -left + max(part, 0) * step
        spans = [[{"s": base + a, "e": base + b} for a, b in own] for own in runs(found, span)]
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.Table.from_arrays([*[group.column(c) for c in ("part", "key", "around")], pa.array(spans, kind)], names=["part", "key", "around", "spans"])

    both = whole.select("part", "key", "around", "body", "n").unionByName(strings.select("part", "key", F.col("own").alias("around"), "body", "n"))
    both = both.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    out = both.groupBy("part", "bucket").applyInArrow(run, "part int, key long, around long, spans array<struct<s:int,e:int>>").where("size(spans) > 0")
    out = cut(out)
    plain = out.where("part < 0").select(F.col("key").alias("anchor"), "around", "spans")
    hot = parts.where("part >= 0").select("anchor", "around", "part", "key", "own").join(out.where("part >= 0").select("part", "key", F.col("around").alias("own"), "spans"), ["part", "key", "own"])
    return plain.unionByName(hot.select("anchor", "around", "spans"))


def repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc, mark, spans: byte ranges (not merged, perhaps beyond the text's ends) that repeat; docs as `keyed` gives them."""
    place = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    found = anchors(docs, span)
    several = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("z")).where("n > 1")
    members = cut(found.join(several.select("anchor", (F.col("a") != F.col("z")).alias("differ")), "anchor"))
    alike = members.where("not differ").select("doc", "at", F.struct((place - (span - Q)).alias("s"), (place + span).alias("e")).alias("x"))
    mixed_ = members.where("differ")
    own = mixed_.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("one"))
    crowded = own.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > HOT)
    wanted = own.join(crowded, "anchor", "left").select("anchor", "around", "one.doc", "one.at", "n", F.col("m").isNotNull().alias("hot"))
    spans = ordered(cut(neighbourhoods(wanted, docs, span)), span)
    differing = mixed_.join(spans, ["anchor", "around"]).select("doc", "at", F.explode("spans").alias("r")).select("doc", "at", F.struct((place + F.col("r.s")).alias("s"), (place + F.col("r.e")).alias("e")).alias("x"))
    every = alike.unionByName(differing).groupBy("doc", F.shiftrightunsigned("at", PLACE_BITS).alias("mark"))
    return every.agg(F.collect_list("x").alias("spans"))


def remove_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256, runs (removed byte ranges) of every text."""
    own = keyed(docs)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, spans in zip(byte_rows(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x in sorted((max(0, x["s"]), min(len(text), x["e"])) for x in spans or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                row = (kept, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"s": a, "e": b} for a, b in merged])
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])

    joined = own.join(cut(repeats(own, span)), ["doc", "mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<s:int,e:int>>")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
