"""Name columns: tokens of file names, similarity, phase and side, keys that pair runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for one word.
SYNONYMS = {
    "reach": "reach", "reachdx": "reach", "reachsx": "reach", "reaching": "reach", "sin": "sx", "sx": "sx", "left": "sx", "lt": "sx",
    "des": "dx", "dx": "dx", "right": "dx", "rt": "dx", "deltroide": "deltoide", "biciite": "bicipite", "bic": "bicipite",
}
#: Words that say nothing about what was recorded.
STOP = ("eeg", "emg", "otb", "mff", "sub", "ses", "pre", "post", "aligned", "session")
MOVEMENT = "reach|movement|movimento|motor"
NOT_MOVEMENT = "rest|mmn|ssr|cmv|mvc"


def base_name(path: Column) -> Column:
    """The last part of a path, without its ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), r"\.[^.]*$", "")


def tokens(path: Column) -> Column:
    """Sorted different words of a name: lower case, synonyms mapped, stop words, numbers and letters with a number left out."""
    words = F.split(F.trim(F.regexp_replace(F.lower(base_name(path)), "[^a-z0-9]+", " ")), " ")
    named = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    mapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(named, w), w))
    useful = F.filter(mapped, lambda w: (w != "") & ~w.isin(*STOP) & ~w.rlike(r"^[a-z]*[0-9]+$"))
    return F.array_sort(F.array_distinct(useful))


def side(words: Column) -> Column:
    return F.when(F.array_contains(words, "dx"), "dx").when(F.array_contains(words, "sx"), "sx").otherwise("")


def similarity(a: Column, b: Column) -> Column:
    """Common words of two token arrays, two more for the same side, two less for different sides, zero if one is empty."""
    sides = F.when((side(a) == "") | (side(b) == ""), 0).when(side(a) == side(b), 2).otherwise(-2)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.array_intersect(a, b)) + sides)


def sanitized(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "run").otherwise(out)


def file_tag(pair: Column, phase: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", pair, phase), "[^A-Za-z0-9_-]", "_")


def phase(session: Column) -> Column:
    """pre or post if a word of the session's name says so, else what follows `ses-`, else `session`."""
    words = F.split(F.lower(session), "[^a-z0-9]+")
    suffix = F.regexp_extract(F.lower(session), "ses-?([a-z0-9]+)", 1)
    own = F.when(F.array_contains(words, "pre") | (suffix == "pre"), "pre").when(F.array_contains(words, "post") | (suffix == "post"), "post")
    return F.coalesce(own, F.when(suffix != "", suffix), F.lit("session"))


def phase_anywhere(path: Column) -> Column:
    """The older rule: `pre` anywhere in the path, then `post`."""
    low = F.lower(path)
    suffix = F.regexp_extract(low, "ses-?([a-z0-9]+)", 1)
    return F.when(low.contains("pre"), "pre").when(low.contains("post"), "post").when(suffix != "", suffix).otherwise("session")


def phase_order(name: Column) -> Column:
    return F.when(F.lower(name) == "pre", 0).when(F.lower(name) == "post", 1).otherwise(2)


def is_movement(*texts: Column) -> Column:
    both = F.lower(F.concat_ws(" ", *texts))
    return both.rlike(MOVEMENT) & ~both.rlike(NOT_MOVEMENT)


def trimmed_key(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "[_-]{2,}", "_"), "^[_-]+|[_-]+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "pair").otherwise(out)


def prepost_key(pair: Column) -> Column:
    """The pair's name without pre and post, so that both runs get one key."""
    out = F.regexp_replace(F.lower(pair), "(?<=ses)-?(pre|post)", "")
    return trimmed_key(F.regexp_replace(out, "(^|[_-])(pre|post)(?=$|[_-])", "_"))


def side_key(pair: Column) -> Column:
    """The pair's name without its side."""
    return trimmed_key(F.regexp_replace(F.lower(pair), "(^|[_-])(dx|sx|right|left|des|sin)(?=$|[_-])", "_"))


def side_of_name(pair: Column) -> Column:
    low = F.lower(pair)
    word = F.regexp_extract(low, "(^|[^a-z])(dx|sx|right|left|des|sin|destra|sinistra)([^a-z]|$)", 2)
    return F.when(word.isin("dx", "right", "des", "destra") | low.contains("reachdx"), "dx").when(word.isin("sx", "left", "sin", "sinistra") | low.contains("reachsx"), "sx").otherwise("")


def subject_order(pair: Column) -> Column:
    """The first number in the name, infinite if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(pair, "([0-9]+)", 1), F.lit("")), F.lit("999999999")).cast("double"), F.lit(float("inf")))


def short_label(pair: Column, phase_name: Column) -> Column:
    subject = F.nullif(F.upper(F.regexp_extract(F.lower(pair), "(?:sub-?)?([a-z]?[0-9]+)", 1)), F.lit(""))
    return F.concat_ws(" ", F.coalesce(subject, pair), F.nullif(side_of_name(pair), F.lit("")), phase_name)


def report_place(path: Column) -> tuple[Column, Column]:
    """Pair and phase of a path that ends in pair/phase/report.json."""
    at = r"([^/]+)/([^/]+)/[^/]+$"
    return F.regexp_extract(path, at, 1), F.regexp_extract(path, at, 2)


def event_code_class(code: Column) -> Column:
    return F.when(code.isin("DIN1", "DIN4", "DIN5"), "OTB_trigger").otherwise("OTB_reconstructed")


#: Words of a pair's name that name no recording, and what a path of either side holds.
PAIR_STOP = ("bids", "ses", "session", "pair", "pre", "post")
SIDE_MARKS = {"dx": "dx|destra|right", "sx": "sx|sin|left"}


def pair_tokens(pair: Column, phase_name: Column) -> Column:
    """Different words of two signs or more of a pair's name in order, without those of `PAIR_STOP`, and its phase if it is not among them."""
    words = F.split(F.regexp_replace(F.lower(pair), "[^a-z0-9]+", "_"), "_")
    own = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*PAIR_STOP)))
    low = F.lower(F.coalesce(phase_name, F.lit("")))
    return F.when((low == "") | F.array_contains(own, low), own).otherwise(F.array_append(own, low))


def pair_side(pair: Column) -> Column:
    low = F.lower(pair)
    return F.when(low.rlike("_dx(_|$)|reachdx|destra|right"), "dx").when(low.rlike("_sx(_|$)|reachsx|sin|left"), "sx").otherwise("")


def side_compatible(side_name: Column, path: Column) -> Column:
    """Whether a path may belong to that side; every path may belong to none."""
    low = F.lower(path)
    return F.when(side_name == "dx", low.rlike(SIDE_MARKS["dx"])).when(side_name == "sx", low.rlike(SIDE_MARKS["sx"])).otherwise(F.lit(True))


def token_score(words: Column, path: Column) -> Column:
    """How many of the words a path holds anywhere."""
    return F.size(F.filter(words, lambda w: F.contains(F.lower(path), w)))
