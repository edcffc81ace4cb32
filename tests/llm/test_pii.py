"""Base spans against the plain patterns; disguises map back to the source."""

import hashlib
import random
import re

import pytest
from twinclock.llm import pii
from twinclock.llm.queries import QUERIES

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def ok(k, s):
    digits = re.sub("[^0-9]", "", s)
    return [True, k == 1 and all(int(p) <= 255 for p in s.split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]


def plain(t):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(t) if ok(k, m[0]))


def test_base_like_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["1", "25", "4", ".", "@", "a", "-", " ", "+", "(", "é", "a@b.c", "1.2.3.4", "4111111111111111", "١"]) for _ in range(rng.randrange(30)))
        assert pii.base_spans(t) == plain(t), t


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("é jane at mail2 dot example dot org!", "email", "jane at mail2 dot example dot org"),
        ("x ｊohn@exаmple.com", "email", "ｊohn@exаmple.com"),
        ("１９２.168.0.1", "ip", "１９２.168.0.1"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("card " + "four" + " one" * 15, "card", "four" + " one" * 15),
        ("a​@b.com", "email", "a​@b.com"),
        ("write j.doe (at) site dot com today", "email", "j.doe (at) site dot com"),
        ("john@example dot com", "email", "john@example dot com"),
        ("ask john@mail dot example.org, ok", "email", "john@mail dot example.org"),
        ("john at example.com.", "email", "john at example.com"),
        ("jane.doe at mail.example [dot] org", "email", "jane.doe at mail.example [dot] org"),
        ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
        ("10.0 dot 0.1", "ip", "10.0 dot 0.1"),
        ("\U0001d423\U0001d428\U0001d421\U0001d427@example.com", "email", "\U0001d423\U0001d428\U0001d421\U0001d427@example.com"),
        ("ⓙohn@examp\u2113e.com", "email", "ⓙohn@examp\u2113e.com"),
    ],
)
def test_disguises(text, kind, part):
    a = text.index(part)
    assert (a, pii.KINDS.index(kind), a + len(part)) in pii.normalised_spans(text)


@pytest.mark.parametrize("text", ["", "one two three", "meet at noon", "the point is (1) and at [.]", "seven eight", "un deux trois quatre cinq", "naïve café 12.5", "look at example.com now", "see us at example.com/a", "john at noon.Then", "at 12.30pm", "he is at 5.pm", "300 dot 1 dot 1 dot 1", "the point is 1 dot 2 dot 3", "№ 5 at 20 ℃"])
def test_clean(text):
    assert not pii.normalised_spans(text)


def test_long_texts_stay_linear():
    for t in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "one " * 60_000, "a at b " * 40_000, "[" * 200_000):
        pii.base_spans(t)
        pii.normalised_spans(t)
    for t in ("a@b dot " * 40_000, "1 dot " * 60_000, "a at b.c" * 40_000, "a at " + "b." * 150_000, "x" * 300_000 + " at b.com", ". at a.b" * 40_000):
        pii.normalised_spans(t)


def test_addresses_that_stand_in_the_source_are_not_joined_to_others():
    """An at word before an address is prose."""
    assert not pii.normalised_spans("write john at john.doe@example.com")
    assert pii.listed(pii.normalised_spans("john@example dot com")) == "email:0:20"


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "john at example.com", 5), (1, "john at example.com", 5)], "doc_id long, text string, n_email int")
    assert [r.spans for r in pii.find(docs).collect()] == ["email:0:19"] * 2
    assert pii.find(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    texts = {1: "a@b.c", 2: None, 3: "", 4: "é a@b.c x [at] y [dot] z"}
    spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "1.2.3.4", "x")], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == 5
    assert [got[4].n_email, got[4].n_ip] == [1, 0] and got[4].base_sha256 == hashlib.sha256(b"email:2:7").hexdigest()
    assert got[4].spans == "email:2:7,email:8:24"
    assert got[2].spans == got[3].spans == "" and got[None].spans == "ip:0:7"


def test_looks_lose_nothing(monkeypatch):
    rng = random.Random(8)
    parts = ["jane", "mail", " at  ", " at ", "  at ", " dot ", "  dot  ", " point ", ".", "org", "one", "two", "fünf", "25", "(", ")", '"', "_", " ", ", ", "-", " [dot] ", "(at)", "x" * 64, "plus", "ſix", "poınt"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(24))) for _ in range(4000)]
    texts += ["jane at  mail dot org", "jane at mail.a dot b dot org", "jane at " + ".".join(["h" * 40] * 3) + " dot org", "(4222-2222-2222-two)", '"4222 2222 2222 two"', "(ſix 011 000990139 four)"]
    guarded = [pii.normalised_spans(t) for t in texts]
    assert all(guarded[-6:-1])
    monkeypatch.setattr(pii, "may_spell", lambda low: True)
    monkeypatch.setattr(pii, "may_address", lambda text, low: True)
    for t, g in zip(texts, guarded, strict=True):
        assert g == pii.normalised_spans(t), t
