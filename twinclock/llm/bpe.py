"""Byte-level BPE: merges by a priority queue over a linked symbol list, and the way back.

Null texts count as empty and give no ids. Repeated rows are coded one by one, very long pieces cost
O(n log n). Other columns of the input are left out of `encode`'s result unless asked for in `keep`.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, scratch_names, table

#: Fixed value: the pattern that parts a text before merging, as the vocabulary's public notes give it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts below U+0250, where the classes are short; the standard library's matcher is faster.
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
CACHED_PIECES = 60_000  # a generation of the piece cache; two are kept
LONGEST_CACHED = 48


def byte_signs() -> list[str]:
    """The visible sign that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """One vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        signs = byte_signs()
        back = {s: b for b, s in enumerate(signs)}
        self.byte_id = [vocab[s] for s in signs]
        #: left id and right id in one integer -> rank; the merged id by rank
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [vocab[a + b] for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if i not in added.values()}
        self.text_of |= {i: t.encode() for t, i in added.items()}
        self.added = added
        self.added_at = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.parts = regex.compile(PIECES).findall
        self.latin_parts = re.compile(LATIN_PIECES).findall
        self.beyond_latin = re.compile("[^\0-\u024f]").search
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.aged: dict[str, tuple[int, ...]] = {}

    def merge_piece(self, data: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked pair again and again; entries whose pair is gone are skipped.

        An entry of the queue is rank and place in one integer: equal ranks go from left to right.
        """
        byte_id, rank = self.byte_id, self.rank.get
        ids = [byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        wide = max(n.bit_length(), 8)
        low = (1 << wide) - 1
        queue = [r << wide | i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        made = self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & low
            j = after[i]
            if j >= n or ids[i] < 0 or rank(ids[i] << 20 | ids[j]) != entry >> wide:
                continue  # stale
            new = ids[i] = made[entry >> wide]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | ids[k])) is not None:
                    heappush(queue, r << wide | i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | new)) is not None:
                heappush(queue, r << wide | h)
        return tuple([x for x in ids if x >= 0])

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.aged.get(text)
        if got is None:
            got = self.merge_piece(text.encode())
        if len(text) <= LONGEST_CACHED:
            if len(self.fresh) >= CACHED_PIECES:
                self.aged, self.fresh = self.fresh, {}
            self.fresh[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        spans = self.added_at.split(text) if self.added_at and self.added_at.search(text) else [text]
        for k, span in enumerate(spans):
            if k % 2:
                out.append(self.added[span])
                continue
            get, more = self.fresh.get, out.extend
            for p in (self.parts if self.beyond_latin(span) else self.latin_parts)(span):
                ids = get(p)
                if ids is None:
                    ids = self.piece(p)
                    get = self.fresh.get
                more(ids)
        return out

    def decode(self, ids) -> str:
        """Concatenate the vocabulary's strings; bytes that are no UTF-8 become the replacement sign. Unknown ids give nothing."""
        get = self.text_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, ids array<int> and decoded string of every whole text."""
    (body,) = scratch_names(docs.select(*keep), "body")

    def run(batches):
        own = codec(vocabulary)
        for batch in by_bytes(batches, body):
            ids = [own.encode(t or "") for t in batch.column(body).to_pylist()]
            cols = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], names=[*keep, "ids", "decoded"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*keep, F.col("text").cast("string").alias(body)).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of `encode`'s columns, taken where the ids are made."""

    def run(batches):
        own = codec(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in by_bytes(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column("text").to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids))
                ids_sha.append(sha(np.array(ids, dtype="<u4").tobytes()))
                text_sha.append(sha(own.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_vocabulary())
