"""Ids and round trips against the installed tokenizers library."""

import hashlib
import random

import numpy as np
from twinclock.llm import bpe

TEXTS = [
    "", "a", " Hello  world's 12,5 \n\n x", "a<|endoftext|>b<|endoftext|>", "é" * 300 + "\U0001f600'll don't'S", "a" * 20000, "\x00￾̀ \x1c\x85\xa0y",
    "  ".join("a" + chr(c) + "1" + chr(c) + "." + chr(c) + " " for c in range(1, 0x400)), "日本語 русский ١٢٣ ²½ ǅ",
]


def test_like_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    own, lib = bpe.codec(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é\n'st1 ñ") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_frames(spark):
    path = bpe.default_vocabulary()
    own = bpe.codec(path)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, None), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t in [*enumerate(TEXTS), (99, "")]:
        ids = own.encode(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    full = bpe.encode(docs, path).where("doc_id = 2").first()
    assert list(full.ids) == own.encode(TEXTS[2]) and full.decoded == TEXTS[2]
    assert bpe.encode_digests(docs.limit(0), path).count() == 0


def test_unknown_ids_give_nothing():
    assert bpe.codec(bpe.default_vocabulary()).decode([999999]) == ""
