r"""Which terms set a source apart from its language, and how far the sources of a language are from each other.

Terms are runs of ASCII letters (in lower case) and of signs beyond ASCII. A language keeps the V terms found in `LEAST_DOCS` of its
documents at least (every row is a document). A group (lang, source) that counts a term c times of N gives it the share
p = 1 + floor(SCALE * (c + 1) / (N + V)); shares p and q are f = floor((p - q)^2 / q) apart. All sums are of whole numbers.

The distance of two groups is the sum of f over all kept terms, split by how many groups hold a term:
- terms in more than `LIGHT` groups go into dense tiles (a block of terms by one or two blocks of sources), numpy arrays of at most
  about `CELLS` cells;
- for the others f of two groups without the term is counted for all, then corrected: by the counts of a group against groups
  without the term (equal counts once, through a histogram), and by the pairs within a term's at most `LIGHT` postings.

Documents are counted in the tasks that read them, so a hot source costs no more than its distinct terms afterwards. Null text, lang
and source count as empty. Repeated rows are documents of their own. A language without kept terms has distance 0 everywhere. Texts of
any length go through in pieces of `PIECE` bytes. Ties go by the item's UTF-8 bytes. Other columns stay out. An empty table
gives no rows. Sums are long: they are exact below 2^63, which shares of up to about 10^9 keep for every V below some 10^9.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, byte_rows, stored, table

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
LIGHT = 4
BLOCK = 64
CELLS = 1 << 11
HELD = 200_000
PIECE = 1 << 20
TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def pieces(text: bytes):
    """The text's terms, in lists of about `PIECE` bytes."""
    plain = text.translate(TERM_BYTES)
    at = 0
    while len(plain) - at > PIECE:
        end = plain.find(b" ", at + PIECE)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of every group; a group has a row of the empty term besides, with zeros."""

    def rows(tallies):
        cols = [[], [], [], [], []]
        for (lang, source), (n, held) in tallies.items():
            terms = [b"", *n]
            cols[0] += [lang] * len(terms)
            cols[1] += [source] * len(terms)
            cols[2] += terms
            cols[3] += [0, *n.values()]
            cols[4] += [0, *[held[t] for t in n]]
        arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in cols[:3]] + [pa.array(c, pa.int64()) for c in cols[3:]]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        tallies: dict = {}
        for batch in by_bytes(batches):
            for lang, source, text in zip(*[byte_rows(batch.column(c)) for c in ("lang", "source", "text")], strict=True):
                n, held = tallies.setdefault((lang, source), (Counter(), Counter()))
                seen: set = set()
                for terms in pieces(text):
                    n.update(terms)
                    own = set(terms) - seen
                    held.update(own)
                    seen |= own
            if sum(len(n) for n, _ in tallies.values()) > HELD:
                yield rows(tallies)
                tallies = {}
        yield rows(tallies)

    narrow = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    part = narrow.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole); null where whole is 0."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, F.nullif(whole, F.lit(0).cast("long")).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """`share` in whole numbers of 64 bits: a long division in three steps, exact for wholes below 2^63 / 1000."""
    out, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + q
    return out + 1


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over a tile's terms, both ways, of every pair of sources between its blocks i and j (or within one)."""
    lang, i, j = rows["lang"].iat[0], rows["i"].iat[0], rows["j"].iat[0]
    heads = rows["term"].isna()
    own = rows[heads]
    names, whole, blocks = own["source"].to_numpy(), own["whole"].to_numpy(np.int64), own["block"].to_numpy()
    at = pd.Series(np.arange(len(names)), index=names)
    posts = rows[~heads]
    codes, _ = pd.factorize(posts["term"])
    counts = np.zeros((len(names), codes.max() + 1 if len(codes) else 0), np.int64)
    counts[at[posts["source"]].to_numpy(), codes] = posts["n"].to_numpy(np.int64)
    p = shares(counts, whole[:, None])
    lone = shares(np.zeros(len(names), np.int64), whole)
    absent = int(own["n"].iat[0]) - counts.shape[1]  # terms of the tile that none of these sources has
    a_, b_, v_ = [], [], []
    for x in np.flatnonzero(blocks == i):
        y = np.flatnonzero(blocks == j) if i != j else np.arange(x + 1, len(names))
        square, far = (p[y] - p[x]) ** 2, (lone[y] - lone[x]) ** 2
        a_ += [np.full(len(y), x), y]
        b_ += [y, np.full(len(y), x)]
        v_ += [(square // p[y]).sum(axis=1) + absent * (far // lone[y]), (square // p[x]).sum(axis=1) + absent * (far // lone[x])]
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    a, b, v = flat(a_), flat(b_), flat(v_)
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": v})


def dense(heavy: DataFrame, groups: DataFrame, sizes: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """lang, a, b, value: sums over the terms of `heavy` (lang, source, term, n; first once a term), tile by tile."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / block)).cast("int")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("heavy") * F.least(F.col("sources"), F.lit(2 * block)) / cells)).cast("int")
    plan = sizes.where("heavy > 0").select("lang", blocks.alias("blocks"), tiles.alias("tiles"))
    block_of = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks that its source's block is in."""
        other = rows.withColumn("block", block_of).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("lang", "tile", "i", "j", "block", "source", "whole", "term", "n")

    posts = heavy.join(plan, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")).withColumn("whole", F.lit(0).cast("long"))
    held = posts.groupBy("lang", "tile").agg(F.count_if("first").alias("n"))
    heads = groups.join(plan, "lang").join(held, "lang").withColumn("term", F.lit(None).cast("string"))
    rows = met(posts).unionByName(met(heads))
    return rows.groupBy("lang", "tile", "i", "j").applyInPandas(tile, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, light: int = LIGHT) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of all other sources, `term` rows of the `top` terms."""
    counts = stored(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")
    posts = counts.where("term <> ''").select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"),
        F.count("*").over(of_term).alias("spread"), (F.col("source") == F.min("source").over(of_term)).alias("first"),
    ).where(F.col("docs") >= least_docs)
    posts = stored(posts)
    own = posts.groupBy("lang").agg(
        F.sum("n").alias("lang_n"), F.count_if("first").alias("v"),
        F.count_if(F.col("first") & (F.col("spread") <= light)).alias("rare"), F.count_if(F.col("first") & (F.col("spread") > light)).alias("heavy"),
    )
    occurring = counts.where("term = ''").select("lang", "source")
    sizes = stored(occurring.groupBy("lang").agg(F.count("*").alias("sources")).join(own, "lang", "left").na.fill(0))
    n = posts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = occurring.join(n, ["lang", "source"], "left").join(sizes.select("lang", "v", "rare"), "lang")
    groups = stored(groups.select("lang", "source", "rare", (F.coalesce("own_n", F.lit(0)) + F.col("v")).alias("whole")))

    zero = F.lit(0).cast("long")
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("whole").alias(f"w{name}"), *(["rare"] if name == "b" else []))
    none_a, none_b = share(zero, F.col("wa")), share(zero, F.col("wb"))
    both = side("a").join(side("b"), "lang").where("a <> b")
    base = both.select("lang", "a", "b", F.coalesce(F.col("rare") * apart(none_a, none_b), zero).alias("value"))

    rare = posts.where(F.col("spread") <= light)
    held = share(F.col("na"), F.col("wa"))
    seen = rare.groupBy("lang", F.col("source").alias("a"), F.col("n").alias("na")).agg(F.count("*").alias("k"))
    seen = seen.join(side("a"), ["lang", "a"]).join(side("b"), "lang").where("a <> b")
    ways = F.inline(F.array(
        F.struct(F.col("a"), F.col("b"), (F.col("k") * (apart(held, none_b) - apart(none_a, none_b))).alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("k") * (apart(none_b, held) - apart(none_b, none_a))).alias("value")),
    ))
    alone = seen.select("lang", ways)

    held_b = share(F.col("nb"), F.col("wb"))
    listed = rare.where("spread > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("x"))  # at most `light` of them
    met = listed.select("lang", F.explode("x").alias("x"), F.col("x").alias("y")).select("lang", "x", F.explode("y").alias("y")).where("x.source <> y.source")
    met = met.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("k"))
    met = met.join(side("a"), ["lang", "a"]).join(side("b").drop("rare"), ["lang", "b"])
    fix = apart(held, held_b) - apart(held, none_b) - apart(none_a, held_b) + apart(none_a, none_b)
    together = met.select("lang", "a", "b", (F.col("k") * fix).alias("value"))

    heavy = dense(posts.where(F.col("spread") > light).select("lang", "source", "term", "n", "first"), groups, sizes)
    pairs = base.unionByName(alone).unionByName(together).unionByName(heavy).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    p, q = share(F.col("n"), F.col("whole")), share(F.col("total"), F.col("lang_whole"))
    of_lang = sizes.select("lang", (F.col("lang_n") + F.col("v")).alias("lang_whole"))
    terms = posts.join(groups.select("lang", "source", "whole"), ["lang", "source"]).join(of_lang, "lang").withColumns({"p": p, "q": q})
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) + coalesce(any_value(v), 0) AS whole FROM g LEFT JOIN occ USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // whole AS p
  FROM gn JOIN kept USING (lang) LEFT JOIN occ USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (ln + v) AS q
  FROM kept LEFT JOIN (SELECT lang, term, sum(n) AS n FROM occ GROUP BY ALL) USING (lang, term)
  JOIN (SELECT lang, sum(n) AS ln FROM occ GROUP BY lang) USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
