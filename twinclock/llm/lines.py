"""Removal of repeated lines by an exact set-similarity join; column functions only.

A line is the set of its words as they stand. A line goes if an earlier line of any text has a Jaccard similarity of
`SIMILARITY` or more with it; earlier is by doc_id, text hash and line number, and is judged on the input, not on what is left.
Words are ordered by rarity: the counts of all words, in a fixed number of hash buckets, rank them. Two similar sets then
share one of their first n - ceil(0.8 n) + 1 words, the prefix. Lines meet at a prefix word; their lengths, the word's place
in both, and the parity bitmaps of both sets bound the overlap from above, and what passes is verified on the whole sets of words.

First all lines with the same words become one class. A class meets the first one, and the last before it, that shares with it
one of its least `KEYS` pairs of neighbouring prefix words; that settles most near copies, however many they are, without pairing them. What is still open then
meets all others at prefix words: a similar set of the same or a smaller size has the word among its first n - ceil(8/9 n) + 1. At a word
that more than `CROWD` classes have in their prefix, they meet only the first of these; what this leaves open meets all others of
the word afterwards.

Null texts count as empty. Lines without words always stay. Rows with equal id and text are repeats of each other
and get equal results; rows without an id are known by their text. Lines end at a line feed. Extra columns stay out. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, stored, table
from .suffixes import keyed

#: The similarity is five fifths less one; all bounds are in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
BUCKETS = 1 << 17
CROWD = 1000  # classes at a prefix word that meet each other at once
KEYS = 6  # pairs of neighbouring prefix words by which a class meets two others
LONG = 64  # words beyond which a line's bitmap has two halves
FILTER_BITS = 22  # the bitmap of wanted lines
WHERE = ("doc", "mark", "line")


def spaced(text: Column) -> Column:
    """The text with white space other than line feeds as spaces; few texts need the pattern."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    return F.when(other, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def listed(rows: DataFrame, at: str, value: str) -> str:
    """The values as one text, in order of `at`: how tables of a fixed size come to the driver."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value].cast("string")), ",")).first()[0]


def rarity(docs: DataFrame) -> Column:
    """array<tinyint> by hash bucket: a step of the logarithm of how often the bucket's words occur, 1 to 127.

    The table has a fixed size at any size of the corpus; it comes to the driver as one text and goes out as a literal.
    """
    words = docs.select(F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    words = words.where("w <> ''").select(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("b"))
    counts = words.groupBy("b").agg(F.count("*").alias("n"))
    every = counts.unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(1).cast("long").alias("n")))
    ranks = every.groupBy("b").agg(F.sum("n").alias("n")).select("b", F.least(F.lit(127), 1 + F.floor(F.log2("n") * 4)).cast("int").alias("r"))
    return F.split(F.lit(listed(ranks, "b", "r")), ",").cast("array<tinyint>")  # folded into one literal


def sets_of(lines: DataFrame, ranks: Column) -> DataFrame:
    """doc, mark, line, id (hash of the set), bits and bits2 (parity bitmap), n, prefix (hashes of its rarest words) of lines; n may be 0."""
    hashed = lines.select(*WHERE, F.array_distinct(F.transform(words_of(F.col("body")), lambda w: F.xxhash64(w))).alias("own"))
    key = lambda h: F.shiftleft(F.get(ranks, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    keys = hashed.select(*WHERE, F.sort_array(F.transform("own", key)).alias("keys"))
    n = F.size("keys")
    first, (bits, half) = F.slice("keys", F.lit(1), prefix_size(n)), parities(F.col("keys"), n)
    return keys.select(*WHERE, F.xxhash64("keys").alias("id"), bits.alias("bits"), half.alias("bits2"), n.alias("n"), F.transform(first, lambda x: (x % 2147483647).cast("int")).alias("prefix"))


def parities(keys: Column, n: Column) -> tuple[Column, Column]:
    """The set's parity bitmap, and that of half of its words where they are many: two bitmaps differ in no more bits than the sets in words."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    none = F.lit(0).cast("long")
    half = F.aggregate(keys, none, lambda a, x: F.when(x.bitwiseAND(64) == 0, a.bitwiseXOR(one(x))).otherwise(a))
    return F.aggregate(keys, none, lambda a, x: a.bitwiseXOR(one(x))), F.when(n > LONG, half).otherwise(none)


def prefix_size(n: Column) -> Column:
    return (n - F.ceil(n * F.lit(NUMERATOR) / DENOMINATOR) + 1).cast("int")


def short_size(n: Column) -> Column:
    """How many of its rarest words a set needs to share one with the prefix of a similar set of at least its size."""
    return (n - F.ceil(n * F.lit(2 * NUMERATOR) / (NUMERATOR + DENOMINATOR)) + 1).cast("int")


def classes_of(lines: DataFrame) -> DataFrame:
    """One row for each different set: c (a number, in the order of first lines), id, bits, bits2, n, doc, mark, line of its first line, prefix."""
    first = lines.groupBy("id", "bits", "bits2", "n").agg(F.min(F.struct(*WHERE)).alias("at"), F.any_value("prefix").alias("prefix"))
    return first.orderBy("at").select(F.monotonically_increasing_id().alias("c"), "id", "bits", "bits2", "n", "at.doc", "at.mark", "at.line", "prefix")


def near_enough(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Length and bitmap filters: sets of these n, bits and bits2 may be similar enough."""
    n, m = a("n"), b("n")
    whole, half = (a(c).bitwiseXOR(b(c)) for c in ("bits", "bits2"))
    apart = F.when((n > LONG) & (m > LONG), F.bit_count(half) + F.bit_count(half.bitwiseXOR(whole))).otherwise(F.bit_count(whole))
    return (n * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n * NUMERATOR) & (apart * (NUMERATOR + DENOMINATOR) <= n + m)


def may_match(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Length, bitmap and place filters: sets that share a word, the pos-th of each, may be similar enough."""
    n, m = a("n"), b("n")
    # with this word, at most so many words can be shared from here on, and so many before
    shared = 1 + F.least(n - 1 - a("pos"), m - 1 - b("pos")) + F.least(a("pos"), b("pos"))
    place = shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n + m)
    return near_enough(a, b) & place


def first_meetings(classes: DataFrame) -> DataFrame:
    """Pairs (c, d) of classes, c the first or the last before d that has one of d's keys, that pass the filters; a key stands for two neighbouring prefix words."""
    keys = F.transform(F.sequence(F.lit(1), F.size("prefix") - 1), lambda i: F.xxhash64(F.get("prefix", i - 1), F.get("prefix", i)))
    rows = classes.where("n > 4").select("c", "n", "bits", "bits2", F.explode(F.slice(F.sort_array(keys), 1, KEYS)).alias("key"))
    own, what = Window.partitionBy("key").orderBy("c"), F.struct("c", "n", "bits", "bits2")
    two = rows.withColumn("two", F.array(F.first(what).over(own), F.lag(what).over(own)))
    two = two.where(F.col("two")[0]["c"] < F.col("c"))  # most keys have one class only
    met = two.withColumn("other", F.explode("two")).where((F.col("other.c") < F.col("c")) & near_enough(lambda x: F.col(f"other.{x}"), F.col))
    return met.select(F.col("other.c").alias("c"), F.col("c").alias("d")).distinct()


def prefix_rows(classes: DataFrame, *more: str) -> DataFrame:
    """tok, c, n, bits, bits2, pos of every prefix word of the classes; smaller sets are only similar to equal ones."""
    return classes.where("n > 3").select("c", "n", "bits", "bits2", *more, F.posexplode("prefix").alias("pos", "tok"))


def at_words(classes: DataFrame) -> DataFrame:
    """The rows of words that several classes share; times: how many; least: the first of them."""
    own = Window.partitionBy("tok")
    return prefix_rows(classes, "open").withColumns({"times": F.count("*").over(own), "least": F.min("c").over(own)}).where("times > 1")


def meetings(classes: DataFrame) -> DataFrame:
    """Pairs (c, d) of classes, d the later and open, that share a prefix word and pass the filters, their sizes (n the smaller, m) and at how many words they met.

    Both sides of the join read one exchange; only the left one is counted by word. The smaller set stands on the left, of equal ones the earlier, with the words that
    `short_size` gives it. At a crowded word one row, the first class, stands on the left; it meets itself too, in a row that
    names the word.
    """
    col = lambda side: lambda name: F.col(f"{side}.{name}")
    crowded = F.col("times") > CROWD
    a = at_words(classes).where(F.when(crowded, F.col("c") == F.col("least")).otherwise(F.col("pos") < short_size(F.col("n")))).alias("a")
    b = prefix_rows(classes, "open").alias("b")
    earlier, same = F.col("a.c") < F.col("b.c"), F.col("a.c") == F.col("b.c")
    smaller = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & earlier
    wanted = F.when(F.col("a.times") > CROWD, same | earlier & F.col("b.open")).otherwise(smaller & F.when(earlier, F.col("b.open")).otherwise(F.col("a.open")))
    pairs = a.join(b, (F.col("a.tok") == F.col("b.tok")) & may_match(col("a"), col("b")) & wanted)
    both = [f(F.col(f"a.{x}"), F.col(f"b.{x}")).alias(y) for x, f, y in (("c", F.least, "c"), ("c", F.greatest, "d"), ("n", F.least, "n"), ("n", F.greatest, "m"))]
    return pairs.select(*both, F.when(same, F.col("a.tok")).alias("crowded")).groupBy("c", "d", "crowded").agg(F.any_value("n").alias("n"), F.any_value("m").alias("m"), F.count("*").alias("s"))


def enough_shared() -> Column:
    """Of a pair (n, m, s) that met at all s words that the smaller set's first words and the other's prefix share: those and all words behind are enough."""
    behind = F.greatest(F.col("n") - short_size(F.col("n")), F.col("m") - prefix_size(F.col("m")))
    return (F.col("s") + behind) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("n") + F.col("m"))


def crowded_meetings(crowd: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs (c, d) of classes that meet at a crowded word and pass the filters; d has no earlier similar class yet."""
    col = lambda side: lambda name: F.col(f"{side}.{name}")
    a, b = crowd.alias("a"), crowd.join(matched, "c", "left_anti").alias("b")
    pairs = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.c") < F.col("b.c")) & may_match(col("a"), col("b")))
    return pairs.select(F.col("a.c").alias("c"), F.col("b.c").alias("d")).distinct()


def among(rows: DataFrame, *at: str) -> Column:
    """Whether a row's columns `at` may be those of one of these rows: a bitmap of fixed size, which lets few others pass while they are few."""
    words = 1 << FILTER_BITS - 6
    place = F.xxhash64(*at)
    which, bit = F.shiftright(place.bitwiseAND((1 << FILTER_BITS) - 1), 6).cast("int"), place.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    spark = rows.sparkSession
    some = rows.select(which.alias("k"), one.alias("x")).unionByName(spark.range(words).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("x")))
    bitmap = F.split(F.lit(listed(some.groupBy("k").agg(F.bit_or("x").alias("x")), "k", "x")), ",").cast("array<bigint>")
    return F.get(bitmap, which).bitwiseAND(one) != 0


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes (c) that have an earlier similar one among the pairs (c, d), by the words of their first lines.

    Each class is held against the first that it met, and only what stays open against the others, so that a group of near copies
    is not held pair by pair. Only lines that a bitmap of the wanted ones lets pass leave their task.
    """
    need = stored(pairs.select("c").unionByName(pairs.select(F.col("d").alias("c"))).distinct().join(classes.select("c", *WHERE), "c"))
    lines = docs.select("doc", "mark", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line", "body")).where(among(need, *WHERE))
    sets = stored(lines.join(need, [*WHERE]).select("c", F.array_distinct(words_of(F.col("body"))).alias("words")).dropDuplicates(["c"]))

    def alike(some: DataFrame) -> DataFrame:
        both = some.join(sets.withColumnRenamed("words", "c_words"), "c").join(sets.select(F.col("c").alias("d"), F.col("words").alias("d_words")), "d")
        shared = F.size(F.array_intersect("c_words", "d_words"))
        return both.where(shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.size("c_words") + F.size("d_words"))).select(F.col("d").alias("c")).distinct()

    early = stored(alike(pairs.groupBy("d").agg(F.min("c").alias("c"))))
    open_ = pairs.select("c", "d").join(early.select(F.col("c").alias("d")), "d", "left_anti")
    out = stored(early.unionByName(alike(open_)))
    for used in (need, sets, early):
        free(used)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc, mark, gone (array of line numbers, from 0): what similar earlier lines take away; docs as `keyed` gives them."""
    ranks = rarity(docs)
    split = docs.select("doc", "mark", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line", "body"))
    lines = stored(sets_of(split, ranks))  # the condition comes after: before, Spark would work the sets out for it as well
    classes = stored(classes_of(lines.where("n > 0")))
    first = stored(first_meetings(classes))  # `verified` reads its pairs again and again
    near = verified(first, classes, docs)
    free(first)
    met = stored(meetings(classes.join(near.withColumn("near", F.lit(True)), "c", "left").withColumn("open", F.col("near").isNull())))
    some = met.where("c <> d")
    crowded = met.where("crowded is not null").select(F.col("crowded").alias("tok"))
    if crowded.isEmpty():
        late = verified(some.where(enough_shared()), classes, docs)
        matched = stored(near.unionByName(late))
        free(late)
    else:
        crowd = stored(prefix_rows(classes).where(among(crowded, "tok")).join(crowded, "tok", "left_semi"))
        # classes with crowded words may share more than they met at
        more = some.where(~enough_shared()).join(crowd.select("c").distinct(), "c", "left_semi")
        early = verified(some.where(enough_shared()).unionByName(more), classes, docs)
        late = stored(crowded_meetings(crowd, near.unionByName(early)))
        matched = stored(near.unionByName(early).unionByName(verified(late, classes, docs)).distinct())
        for used in (crowd, early, late):
            free(used)
    free(met)
    free(near)
    verdict = classes.join(matched.withColumn("hit", F.lit(True)), "c", "left").select("id", "bits", "bits2", "n", F.struct(*WHERE).alias("first"), F.coalesce("hit", F.lit(False)).alias("hit"))
    gone = lines.where("n > 0").select(*WHERE, "id", "bits", "bits2", "n").join(verdict, ["id", "bits", "bits2", "n"]).where(F.col("hit") | (F.struct(*WHERE) != F.col("first")))
    out = stored(gone.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("line")).alias("gone")))
    for used in (lines, classes, matched):
        free(used)
    return out


def remove_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, n_lines, n_removed, gone (line numbers from 0) and kept (the text that remains) of every row."""
    own = keyed(docs, keep)
    gone = removed_lines(own.select("doc_id", "text", "doc", "mark"))
    touched = among(gone, "doc", "mark")  # other texts stay in their task
    names = ["doc_id", *keep, "text"]
    whole = own.where(~touched).select(*names, F.array().cast("array<int>").alias("gone"))
    cut = own.where(touched).join(gone, ["doc", "mark"], "left").select(*names, F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    parts = whole.unionByName(cut).select("doc_id", *keep, F.split("text", "\n").alias("parts_"), "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size("parts_") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.array_join("parts_", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts_", i)), "\n"))
    return parts.select("doc_id", *keep, F.size("parts_").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), "gone", kept.alias("kept"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("gone", lambda i: i.cast("string")), ",").alias("removed_lines"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same in plain SQL: sets of words as lists, all pairs that share one of the rarer words.
SQL = r"""
with lines as (
  select doc_id, p.line, list_distinct(list_filter(regexp_split_to_array(p.body, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words, p.body
  from (select doc_id, unnest(list_transform(parts, lambda b, i: {'line': i - 1, 'body': b})) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), numbered as (
  select row_number() over (order by doc_id, line) as k, doc_id, line, list_sort(words) as words, len(words) as n from lines where len(words) > 0
), firsts as (
  select min(k) as k, words, any_value(n) as n from numbered group by words
), counts as (
  select w, count(*) as c from (select unnest(words) as w from firsts) group by w
), ranked as (
  select k, n, w, row_number() over (partition by k order by c, w) as pos from (select k, n, unnest(words) as w from firsts) join counts using (w)
), prefixes as (
  select k, n, w from ranked where pos <= n - (4 * n + 4) // 5 + 1
), pairs as (
  select distinct b.k as k, a.k as early from prefixes a join prefixes b on a.w = b.w and a.k < b.k and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
), alike as (
  select distinct p.k from pairs p join firsts x on x.k = p.k join firsts y on y.k = p.early
  where 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)
), gone as (
  select l.doc_id, l.line from numbered l join firsts f on f.words = l.words where l.k <> f.k or f.k in (select k from alike)
), per_line as (
  select l.doc_id, l.line, l.body, g.line is not null as out from lines l left join gone g on g.doc_id = l.doc_id and g.line = l.line
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (out)::bigint as n_removed,
  coalesce(string_agg(line::varchar, ',' order by line) filter (out), '') as removed_lines,
  sha256(coalesce(string_agg(body, chr(10) order by line) filter (not out), '')) as kept_sha256
from per_line group by doc_id
"""
