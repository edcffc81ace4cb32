"""Secret scans over a ledger of blobs: content-address, scan what is unseen, join findings back to all paths.

Every text is a version of a path; equal texts are one blob, named by SHA-256. A ledger row says which spans a rule
version found in a blob. Only pairs of blob and rule version that the ledger lacks are scanned. All steps are
built-in column functions. The registered query goes through a ledger of its own, which it fills.

Null texts count as empty and hold nothing; repeated rows keep their rows; extra columns stay out. Spans with equal starts are
listed in the order of the rules. An empty table gives no rows, and a ledger folder without files is an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table


@dataclass(frozen=True)
class Rule:
    """What a kind of secret looks like; `group` of a match must have `least` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"


#: Kinds in the order in which equal starts are listed. A run of hexadecimal digits or a key of fewer characters
#: than asked for can't match at a later start either, so its least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)


#: Public forms of keys that services hand out, found beside the base kinds.
SERVICE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 29),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 27),
)
LEDGER = "blob string, kind string, version string, spans array<struct<start:int,ord:int,stop:int,kind:string>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, stop, kind>> of the rule's matches, in code points, end exclusive.

    The text between matches and the matches themselves come as two arrays; running lengths give the places.
    """
    found, sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), sized.alias("own"))
    none = F.array().cast("array<struct<start:int,stop:int,own:int>>")
    walk = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, r: F.struct(
            (s["at"] + F.length(r["gap"]) + F.coalesce(F.length(r["hit"]), F.lit(0))).alias("at"),
            F.when(r["hit"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct((s["at"] + F.length(r["gap"])).alias("start"), (s["at"] + F.length(r["gap"]) + F.length(r["hit"])).alias("stop"), F.length(r["own"]).alias("own")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    kept = F.transform(F.filter(walk, lambda m: m["own"] >= rule.least), lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))
    empty = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")
    return F.when(text.rlike(rule.pattern), kept).otherwise(empty)


def addressed(docs: DataFrame) -> DataFrame:
    """path (the doc_id), blob, text: the columns the ledger works on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("body"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for unseen pairs of blob and rule version.

    Pairs that hold nothing get no row of their own: a row of kind '' and the versions' names says that the blob was scanned.
    """
    blobs = versions.groupBy("blob").agg(F.first("body").alias("body"))
    stamp = lambda r: f"{r.kind}@{r.version}"
    if ledger is None:
        fresh = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.where("kind = ''").select("blob", F.explode(F.split("version", ",")).alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
        fresh = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(~F.forall(F.array(*[F.lit(stamp(r)) for r in rules]), lambda v: F.array_contains(F.col("seen"), v)))
    todo = lambda r: ~F.array_contains("seen", F.lit(stamp(r)))
    spans = [F.when(todo(r), spans_of(F.col("body"), r, k)).otherwise(F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")) for k, r in enumerate(rules)]
    names = F.array_join(F.array_compact(F.array(*[F.when(todo(r), F.lit(stamp(r))) for r in rules])), ",")
    row = lambda kind, version, at: F.struct(F.lit(kind).alias("kind"), version.alias("version"), at.alias("spans"))
    out = F.array(row("", names, F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")), *[row(r.kind, F.lit(r.version), F.col(f"s{k}")) for k, r in enumerate(rules)])
    wide = fresh.select("blob", "seen", *[s.alias(f"s{k}") for k, s in enumerate(spans)])
    return wide.select("blob", F.explode(F.filter(out, lambda x: (x["kind"] == "") | (F.size(x["spans"]) > 0))).alias("x")).select("blob", "x.kind", "x.version", "x.spans")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and all spans of the rules' versions, for every row of `versions`."""
    own = ledger.where(F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules]))
    per_blob = own.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return versions.select("path", "blob").join(per_blob, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")).alias("spans"))


def update_ledger(spark: SparkSession, docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the Parquet ledger at `path` lacks, append it there, and return `findings` of docs."""
    versions = addressed(docs)
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
        ledger.schema  # noqa: B018
    except AnalysisException as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    scan(versions, ledger, rules).write.mode("append").parquet(path)
    return findings(versions, spark.read.schema(LEDGER).parquet(path), rules)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds' counts and digest, and all spans, found through a new ledger."""
    found = update_ledger(spark, table(spark, sf_dir, "documents"), fresh_path(spark), RULES + SERVICE_RULES)
    listed = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["stop"])), ",")
    base = F.filter("spans", lambda m: m["ord"] < len(RULES))
    count = lambda r: F.size(F.filter("spans", lambda m: m["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(r) for r in RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
