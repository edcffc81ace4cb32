"""Personal data with offset-preserving deobfuscation.

A transducer rewrites disguises (look-alike signs, spelled digits, at and dot words, invisible signs) and keeps for each
sign of the normalised text the source span it came from. The detectors run on the source and on the normalised text;
what only the latter shows is mapped back to source characters and added. Spans found in the source always stay.
Each sign of an address may be disguised by itself: signs first, then brackets and spelled digits, then words between blanks.

Null texts count as empty; an empty table gives no rows; repeated rows are treated one by one; columns beside doc_id and text
take no part, whatever their names; of equal starts the kinds come in the order listed. Every pass is linear in the text but for sorting.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Signs of other scripts that look like an ASCII sign.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹒": ".", " ": " ", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0", "plus": "+",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "más": "+",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
AT = r"(?:at|arroba|chez|ät)"
DOT = r"(?:dot|punkt|punto|point|period)"
SIGNS = "".join(map(re.escape, LOOKALIKES)) + INVISIBLE + "٠-٩۰-۹०-९＋-ｚ\u2100-\u213a\u24b6-\u24e9\U0001d400-\U0001d7ff"
SIGN = re.compile(f"[{SIGNS}]")
NUMBER_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: A run of at least four digits of which one or more are spelled.
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:{NUMBER_WORD}|[0-9]+)(?:[ ,.-]{{1,2}}(?:{NUMBER_WORD}|[0-9]+)(?![^\W_])){{3,}}+", re.I)
RUN_PART = re.compile(rf"({NUMBER_WORD})(?![^\W_])([ ,.-]{{1,2}}(?={NUMBER_WORD}(?![^\W_])|[0-9]))?|([0-9]+)([ ,.-]{{1,2}}(?={NUMBER_WORD}(?![^\W_])))", re.I)
BRACKETED = re.compile(rf"[ ]{{0,2}}[\[({{<][ ]{{0,2}}(?:({AT}|@)|({DOT}|\.))[ ]{{0,2}}[\])}}>][ ]{{0,2}}", re.I)
SPACED = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{{1,64}}+([ ]{{1,2}}{AT}[ ]{{1,2}})[A-Za-z0-9-]{{1,63}}+((?:(?:[ ]{{1,2}}{DOT}[ ]{{1,2}}|\.)[A-Za-z0-9-]{{1,63}}+)*?[ ]{{1,2}}{DOT}[ ]{{1,2}}[A-Za-z0-9-]{{1,63}}+(?:[ ]{{1,2}}{DOT}[ ]{{1,2}}[A-Za-z0-9-]{{1,63}}+)*+)", re.I)
#: Of an address with a plain at sign, what follows its first label from the first dot word on.
SIGN_HOST = re.compile(rf"(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9-]{{1,63}}+([ ]{{1,2}}{DOT}[ ]{{1,2}}[A-Za-z0-9-]{{1,63}}+(?:(?:[ ]{{1,2}}{DOT}[ ]{{1,2}}|\.)[A-Za-z0-9-]{{1,63}}+)*+)", re.I)
#: An at word before a host with plain dots that holds a letter and ends as domains do, and isn't the start of an address or of a path.
AT_HOST = re.compile(rf"[ ]{AT}[ ]{{1,2}}((?=[0-9-]*[A-Za-z])[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+){{0,8}}\.(?-i:[a-z]{{2,24}}))(?![\w@%+/:-])(?!\.[A-Za-z0-9])", re.I)
#: Four numbers with a dot word or a dot between them.
DOTTED = re.compile(rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}+((?:(?:[ ]{{1,2}}{DOT}[ ]{{1,2}}|\.)[0-9]{{1,3}}+){{3}})(?![0-9])", re.I)
#: Words after which `at` and a host tell of a place, not of an address.
PROSE = frozenset("look looks looking see seen more us me you him her them it this that these those here there is are was were be been available found find read visit visited online site website page hosted live lives home now out up back only all and or not just shop work works working buy sold in on by start starts arrive arrived stay stayed meet met".split())
WORD_DOT = re.compile(rf"[ ]{{1,2}}{DOT}[ ]{{1,2}}", re.I)


def emails(text: str):
    """The base pattern's leftmost matches: the local part is what stands before an at sign."""
    at, low = text.find("@"), 0
    while at >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str):
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the plain patterns."""
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))


def plain_sign(sign: str) -> str:
    if sign in INVISIBLE:
        return ""
    if (own := LOOKALIKES.get(sign)) is not None:
        return own
    if (digit := unicodedata.digit(sign, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", sign)
    plain = LOOKALIKES.get(plain, plain)
    return plain if len(plain) == 1 and plain.isascii() else sign


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """The text with the edits, and for each piece (start in it, source start, source end, is edit)."""
    out, starts, pieces, at, n = [], [], [], 0, 0
    for a, b, new in edits:
        if a < at:
            continue
        for s, e, t, edited in ((at, a, text[at:a], 0), (a, b, new, 1)):
            if t or edited:
                starts.append(n)
                pieces.append((n, s, e, edited))
                out.append(t)
                n += len(t)
        at = b
    starts.append(n)
    pieces.append((n, at, len(text), 0))
    out.append(text[at:])
    return "".join(out), starts, pieces


def back(starts: list[int], pieces: list[tuple[int, int, int, int]], a: int, b: int) -> tuple[int, int, bool]:
    """Source span of [a, b) of a rewritten text, and whether an edit lies in it."""
    i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
    n, s, _, edited = pieces[i]
    start = s if edited else s + a - n
    n, s, e, edited_j = pieces[j]
    end = e if edited_j else s + b - n
    return start, end, any(p[3] for p in pieces[i : j + 1])


def spelled_edits(text: str):
    for run in SPELLED_RUN.finditer(text):
        a, b = run.span()
        for m in RUN_PART.finditer(text, a, b):
            if m[1]:
                yield m.start(), m.end(), SPELLED[folded(m[1])]
            else:
                yield m.start(4), m.end(4), ""


def bracket_edits(text: str):
    if any(c in text for c in "[({<") and MAY_BRACKET.search(text):
        for m in BRACKETED.finditer(text):
            yield m.start(), m.end(), "@" if m[1] else "."


def dot_edits(text: str, a: int, b: int):
    for d in WORD_DOT.finditer(text, a, b):
        yield d.start(), d.end(), "."


def address_edits(text: str, low: str):
    """At and dot words between blanks, where an address or four numbers stand around them."""
    if may_address(text, low):
        for m in SPACED.finditer(text):
            yield m.start(1), m.end(1), "@"
            yield from dot_edits(text, *m.span(2))
    if any(w in low for w in DOT_WORDS):
        for pattern in (SIGN_HOST, DOTTED):
            for m in pattern.finditer(text):
                yield from dot_edits(text, *m.span(1))
    if any(w in low for w in AT_WORDS):
        for m in AT_HOST.finditer(text):
            b = m.start() - (text[m.start() - 1 : m.start()] == " ")
            a = b
            while a > 0 and b - a <= 64 and text[a - 1] in LOCAL:
                a -= 1
            if 0 < b - a <= 64 and folded(text[a:b]) not in PROSE:
                yield b, m.start(1), "@"


NUMBER_WORDS = frozenset(SPELLED)
AT_WORDS = (" at ", " arroba ", " chez ", " ät ")
DOT_WORDS = ("dot", "punkt", "punto", "point", "period")


WORDS = re.compile(r"[^\W_]+")
FOLDED = str.maketrans("ſıİ", "sii")  # signs that a pattern takes for ASCII letters when it ignores case


def folded(text: str) -> str:
    return (text if text.isascii() else text.translate(FOLDED)).lower()


def may_spell(low: str) -> bool:
    """Whether four number words or digits stand in a row, a cheap look before the pattern that loses nothing."""
    words = WORDS.findall(low)
    if NUMBER_WORDS.isdisjoint(words):
        return False
    return "nnnn" in "".join(["n" if w in NUMBER_WORDS or w[0] in "0123456789" else " " for w in words])


MAY_BRACKET = re.compile(rf"[\[({{<][ ]{{0,2}}(?:{AT}|@|{DOT}|\.)[ ]{{0,2}}[\])}}>]", re.I)
MAY_AT, MAY_DOT = re.compile(rf"[ ]{AT}[ ]", re.I), re.compile(rf"[ ]{DOT}[ ]", re.I)


def may_address(text: str, low: str) -> bool:
    """Whether a dot word stands somewhere behind an at word; a cheap look that loses nothing."""
    return any(w in low for w in DOT_WORDS) and (at := MAY_AT.search(text)) is not None and MAY_DOT.search(text, at.end() - 1) is not None


def sign_edits(text: str, low: str):
    return [(m.start(), m.end(), plain_sign(m[0])) for m in SIGN.finditer(text)] if not text.isascii() else []


def piece_edits(text: str, low: str):
    """Signs in brackets, and digits that are spelled."""
    return [*bracket_edits(text), *(spelled_edits(text) if may_spell(low) else ())]


def normalised_spans(text: str) -> set[tuple[int, int, int]]:
    """(start, kind's number, end) in the source of what the normalised text shows where it was rewritten.

    Each layer rewrites what the one before left; a span is mapped back through all of them.
    """
    layers, now = [], text
    low = None
    for edits in (sign_edits, piece_edits, address_edits):
        low = folded(now) if low is None else low
        if own := sorted(edits(now, low)):
            now, *places = rewrite(now, own)
            layers.append(places)
            low = None
    if not layers:
        return set()
    out = set()
    for a, k, b in base_spans(now):
        changed = False
        for places in reversed(layers):
            a, b, edited = back(*places, a, b)
            changed |= edited
        if changed:
            out.add((a, k, b))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and `base` and `spans`: the listed spans of the plain patterns, and all spans, of every whole text."""

    def run(batches):
        for batch in by_bytes(batches):
            base, full = [], []
            for t in batch.column("text").to_pylist():
                own = base_spans(t or "")
                base.append(own)
                full.append(set(own) | normalised_spans(t or ""))
            sha = [hashlib.sha256(listed(s).encode()).hexdigest() for s in base]
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(KINDS))]
            cols = [batch.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([listed(s) for s in full], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
