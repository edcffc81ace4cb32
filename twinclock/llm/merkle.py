"""Merkle manifest of a dataset: one tree per source, one over the sources' roots, and every row's proof.

H is the lowercase hex SHA-256 of its inputs one after the other; digests go in as hex text. A leaf is H of the row's fields,
each as its UTF-8 length, a colon and the value, or `-` where it is null. Every `FAN` consecutive nodes of a group become their H,
level by level, the last run with fewer or one; what remains is the group's root, a lone leaf itself.

Texts are hashed where they are read and never shuffled. Places within a group come from a sort by ranges (a hot source spreads over all
ranges, repeated rows too) and from counts of each range's share of each group. A level is one window by (group, parent's
place): its list is the parent's preimage and holds the siblings; the first node of each run stands for its parent on the next level.
Proofs go down again: a node's path is its own siblings, then its parent's path. Every level is written, so that a lost executor costs
tasks, not the levels below.

Null fields are `-`; rows of a null source are a group of their own, before all others. Rows without an id come first; rows with
one id go by leaf; repeated rows are leaves of their own. An id that is null counts as the empty text in crc32, so its row is
tampered with. Empty texts are `0:`. Columns beyond the fields stay out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_rest, free, stored, table

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """idx (from 0) and n of every row within its grp by `order`; no task holds a whole group."""
    marked = rows.withColumn("mark", F.monotonically_increasing_id())  # so that equal rows fall into several ranges
    keys = ["grp", *order, "mark"]
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark").withColumn("place", F.monotonically_increasing_id())
    ranged = stored(ranged).withColumn("part", F.shiftright("place", 33))
    parts = ranged.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    by_part = Window.partitionBy("grp").orderBy("part")
    parts = parts.select(
        "grp", "part", "first",
        F.coalesce(F.sum("own").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("own").over(Window.partitionBy("grp")).alias("n"),
    )
    return ranged.join(parts, ["grp", "part"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def climb(nodes: DataFrame, fan: int = FAN, keep: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every group's tree, and the groups' roots. nodes: grp, idx, n, digest; the first level carries `keep`.

    A level has grp, idx, up (the parent's place), left and right (the siblings' digests before and after). Roots have grp, digest, depth.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], []
    while most > 1:
        whole = Window.partitionBy("grp", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = F.col("at").cast("int")
        level = nodes.where("n > 1").withColumns({"up": F.expr(f"idx div {fan}"), "at": F.expr(f"idx % {fan}")}).withColumn("run", F.collect_list("digest").over(whole))
        level = level.select(
            "grp", "idx", "up", "n", *keep,
            F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("right"),
            F.when(F.col("at") == 0, F.sha2(F.array_join("run", ""), 256)).alias("parent"),
        )
        level = stored(level)
        roots.append(nodes.where("n = 1").select("grp", "digest", F.lit(len(levels)).alias("depth")))
        levels.append(level)
        nodes = level.where(F.col("parent").isNotNull()).select("grp", F.col("up").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("parent").alias("digest"))
        keep, most = (), -(-most // fan)
    roots.append(nodes.where("n = 1").select("grp", "digest", F.lit(len(levels)).alias("depth")))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, out


def descend(levels: list[DataFrame], tops: DataFrame, carried: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """grp, idx, path and the carried columns of the lowest level's nodes (groups of one node stay out).

    tops: grp, depth, path and the carried columns of the groups' roots.
    """
    top = lambda k: tops.where(F.col("depth") == k).select("grp", F.lit(0).cast("long").alias("idx"), "path", *carried)
    above = top(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("grp", "idx", "up", "left", "right", *(keep if k == 0 else ()))
        own = own.join(above.withColumnRenamed("idx", "up"), ["grp", "up"])
        step = F.array(F.struct("left", "right")).cast(PATH)
        own = own.select("grp", "idx", F.concat(step, "path").alias("path"), *carried, *(keep if k == 0 else ()))
        above = own.unionByName(top(k)) if k else own
    return above


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column], fan: int = FAN) -> DataFrame:
    """keep's columns, leaf, subroot, root and path (left and right siblings of each level, up to the root) of every row."""
    names = tuple(keep)
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("grp"), order.alias("key"), leaf.alias("digest"), *[c.alias(n) for n, c in keep.items()])
    nodes = placed(rows, ["key", "digest"]).withColumn("leaf", F.col("digest"))
    carried = (*names, "leaf")
    levels, subroots = climb(nodes, fan, carried)
    sources = subroots.withColumnsRenamed({"grp": "key", "digest": "subroot"}).withColumn("grp", F.lit(""))
    upper = placed(sources, ["key"]).withColumn("digest", F.col("subroot"))
    outer, root = climb(upper, fan, ("key", "subroot", "depth"))
    start = root.select("grp", F.col("depth"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    lone = upper.where("n = 1").select("key", "subroot", "depth", F.array().cast(PATH).alias("path"), F.col("subroot").alias("root"))
    tops = lone
    if outer:
        tops = lone.unionByName(descend(outer, start, ("root",), ("key", "subroot", "depth")).select("key", "subroot", "depth", "path", "root"))
    tops = stored(tops.withColumnRenamed("key", "grp"))
    out = nodes.where("n = 1").join(tops.where("depth = 0"), "grp").select(*carried, "subroot", "root", "path")
    if levels:
        out = out.unionByName(descend(levels, tops, ("subroot", "root"), carried).select(*carried, "subroot", "root", "path"))
    for level in outer:
        free(level)
    return out


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.when(crc_rest(F.col("doc_id"), 2) == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    leaf, tampered = leaf_of([F.col(c) for c in FIELDS]), leaf_of([*[F.col(c) for c in FIELDS[:-1]], changed])
    doc = F.col("doc_id").cast("long")
    out = manifest(docs, leaf, F.col("source"), doc, {"doc_id": doc, "tampered": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp,
    sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered
  FROM (SELECT *, CASE WHEN doc_id IS NULL OR xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, c: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, c)), 4294967295::BIGINT),
      4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
up AS (
  SELECT grp, 0 AS lvl, idx, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT grp, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY grp, lvl, idx // 3, n),
sub AS (SELECT grp AS g, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS nr, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS lvl, nr AS idx, n, subroot AS digest FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM up2 WHERE n > 1 GROUP BY lvl, idx // 3, n),
runs AS (
  SELECT grp, lvl, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT grp, lvl, idx, n, digest FROM up UNION ALL SELECT NULL, lvl, idx, n, digest FROM up2) WHERE n > 1),
walk AS (
  SELECT grp, idx AS leaf_idx, 0 AS lvl, idx, tampered AS d, '' AS proof FROM numbered
  UNION ALL
  SELECT w.grp, leaf_idx, w.lvl + 1, w.idx // 3, sha256(l || d || r), proof || l || r FROM walk w JOIN runs s ON s.grp = w.grp AND s.lvl = w.lvl AND s.idx = w.idx),
inner_end AS (SELECT grp, leaf_idx, arg_max(d, lvl) AS d, arg_max(proof, lvl) AS proof FROM walk GROUP BY grp, leaf_idx),
walk2 AS (
  SELECT e.grp, leaf_idx, 0 AS lvl, nr AS idx, d, proof FROM inner_end e JOIN sub ON g = e.grp
  UNION ALL
  SELECT w.grp, leaf_idx, w.lvl + 1, w.idx // 3, sha256(l || d || r), proof || l || r FROM walk2 w JOIN runs s ON s.grp IS NULL AND s.lvl = w.lvl AND s.idx = w.idx),
ended AS (SELECT grp, leaf_idx, arg_max(d, lvl) AS d, arg_max(proof, lvl) AS proof FROM walk2 GROUP BY grp, leaf_idx)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
FROM numbered m JOIN ended e ON e.grp = m.grp AND e.leaf_idx = m.idx JOIN sub ON g = m.grp CROSS JOIN (SELECT digest AS root FROM up2 WHERE n = 1)
"""
