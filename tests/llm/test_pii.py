import hashlib
import random
import re

import pytest
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import pii
from tidelog.llm.common import table


def plain_base(text):
    """The base patterns as they are written down, without any of the shortcuts."""

    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda t: re.sub("[^0-9]", "", t)
    cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def test_base_rules_on_random_texts():
    rng = random.Random(5)
    for alphabet in ("ab@.-+1", "0123.", "0123456789 -", "+1 ().-a2", "4+.@ 0-1a"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.spans_of(text)[0] == plain_base(text), text


def test_table(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    texts = dict(documents.select("doc_id", "text").collect())
    rows = pii.found(documents).collect()
    assert {row.doc_id for row in rows} == set(texts)
    for row in rows:
        base = plain_base(texts[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "inside"),
    [
        ("write to jane.doe [at] mail (dot) example [dot] com today", "email", "jane.doe [at] mail (dot) example [dot] com"),
        ("write to jane at example dot com today", "email", "jane at example dot com"),
        ("jane dot doe at example dot com", "email", "jane dot doe at example dot com"),
        ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jane​@exam​ple.com", "email", "jane​@exam​ple.com"),
        ("call plus one five five five one two three four five", "phone", "plus one five five five one two three four five"),
        ("at ١٢٧.٠.٠.١ now", "ip", "١٢٧.٠.٠.١"),
        ("host one two seven dot zero dot zero dot one", "ip", "one two seven dot zero dot zero dot one"),
        ("juan arroba ejemplo punto com", "email", "juan arroba ejemplo punto com"),
        ("a juan (arroba) ejemplo (punto) com.", "email", "juan (arroba) ejemplo (punto) com"),
        ("jean point dupont arobase exemple point fr", "email", "jean point dupont arobase exemple point fr"),
        ("jean arobase exemple.fr", "email", "jean arobase exemple.fr"),
        ("an hans at beispiel punkt de bitte", "email", "hans at beispiel punkt de"),
        ("plus vier neun eins fünf eins zwei drei vier fünf sechs", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs"),
        ("más plus tres cuatro seis uno dos 345 678", "phone", "plus tres cuatro seis uno dos 345 678"),
        ("host one 9 two dot zero dot 0 dot one", "ip", "one 9 two dot zero dot 0 dot one"),
        ("zu 𝐣𝐚𝐧𝐞@𝐦𝐚𝐢𝐥.com", "email", "𝐣𝐚𝐧𝐞@𝐦𝐚𝐢𝐥.com"),
        ("x a@b at c dot d dot e dot f dot g dot h dot i dot j dot k dot l dot m", "email", "b at c dot d dot e dot f dot g dot h dot i dot j dot k dot l dot m"),
        ("jane        at    example     dot       com", "email", "jane        at    example     dot       com"),
        ("pay four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, inside):
    base, whole = pii.spans_of(text)
    assert [text[s:e] for s, e in whole[kind] if (s, e) not in base[kind]] == [inside]


@pytest.mark.parametrize(
    ("text", "kind", "inside", "clean"),
    [
        ("to jаne@example.com now", "email", "jаne@example.com", "to <EMAIL> now"),
        ("to jane dot doe@example.com now", "email", "jane dot doe@example.com", "to <EMAIL> now"),
        ("to jane@mail.cоm now", "email", "jane@mail.cоm", "to <EMAIL> now"),
        ("a@b.com or jаne@example.com or c@d.com", "email", "jаne@example.com", "<EMAIL> or <EMAIL> or <EMAIL>"),
        ("host eight point eight point four point four now", "ip", "eight point eight point four point four", "host <IP> now"),
    ],
)
def test_disguises_around_base_spans(text, kind, inside, clean):
    base, whole = pii.spans_of(text)
    assert set(base[kind]) <= set(whole[kind])
    assert [text[s:e] for s, e in whole[kind] if (s, e) not in base[kind]] == [inside]
    assert pii.redacted(text) == clean


@pytest.mark.parametrize("text", ["meet at example.com", "one two three four", "look at the dot com boom", "éàü ñ ß", "(at) [dot]", "a + b . c", "at dot at dot", "look at one point in time", "el punto de vista", "dos tres cuatro", "vier Punkte at home"])
def test_prose_is_left_alone(text):
    assert pii.listed(pii.spans_of(text)[1]) == ""


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1 " * 100_000, "a@" * 150_000, "1." * 150_000, "one " * 60_000, "x dot " * 40_000, "( " * 90_000, " " * 200_000, "x point " * 40_000, "uno " * 60_000, "a arroba " * 30_000, "x" + " " * 100_000 + "at"):
        pii.spans_of(text)


def test_odd_rows(documents):
    frame = documents([(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")]).selectExpr("*", "1 as spans", "2 as n_email")
    rows = pii.found(frame).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in rows) == [("1", 0, ""), ("2", 0, ""), ("3", 1, "email:0:5"), ("3", 1, "email:0:5"), ("None", 1, "email:0:5")]
    assert pii.found(documents([])).count() == 0
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(documents([(1, None), (2, "to a@b.c or +1 555 123 4567.")])).collect()}
    bare = pii.redact(documents([(2, "to a@b.c")]).select("doc_id", "text"))
    assert bare.columns == ["doc_id", "text"] and bare.first().text == "to <EMAIL>"
    assert clean == {1: (None, None), 2: ("to <EMAIL> or <PHONE>.", 22)}
