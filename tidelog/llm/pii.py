"""Personal data: base patterns on the text, and the same patterns behind disguises with offsets kept.

A chain of transducers rewrites a text and carries, for every character it writes, the span of source characters it came
from: look-alike letters and digits of other scripts become ASCII and invisible characters vanish; runs of spelled
digits become digits; `at` and `dot` disguises become signs. Patterns then run on the rewritten text, and what they find
is mapped back to source positions. Found spans that no base span of their kind contains are added; base spans stay.

Positions are code points, ends exclusive. Nulls: a null text is an empty text without spans; a null id keeps its row.
Repeated rows stay. Extra columns are ignored. An empty table gives an empty result. Every rule is linear in the text, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of name@domain; the name is followed back from each sign, so long names cost nothing extra."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split("."))]


def passes_luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for match in CARD.finditer(text):
        if 16 <= match.end() - match.start() <= 37:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                found.append(match.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []


DETECTORS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits, from zero on, and the words for `@` and `.`, in English, German, Spanish and French.
DIGITS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
AT_AND_DOT = (("at", "dot"), ("at|ät", "punkt"), ("arroba", "punto"), ("arobase|arobas", "point"))
SPELLED = {"oh": "0", "zwo": "2"} | {word: str(digit) for words in DIGITS for digit, word in enumerate(words.split())}
AT_WORDS = "|".join(sorted({word for at, _ in AT_AND_DOT for word in at.split("|")}, reverse=True))
DOT_WORDS = "|".join(dot for _, dot in AT_AND_DOT)


@cache
def signs() -> dict[str, str]:
    """What each disguised character stands for."""
    table = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for code in range(0x80, 0x20000):
        sign, kind = chr(code), unicodedata.category(chr(code))
        if sign in table or kind not in ("Nd", "Lu", "Ll"):
            continue
        plain = str(unicodedata.decimal(sign)) if kind == "Nd" else unicodedata.normalize("NFKC", sign)
        if len(plain) == 1 and plain.isascii():
            table[sign] = plain  # digits of all scripts, and letters that are forms of Latin ones
    return table


class Traced:
    """A rewritten text; character i stands for source[starts[i]:ends[i]]."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """With text[i:j] replaced for every (i, j, written), in order; what is written covers the whole of what it replaces."""
        parts, starts, ends, last = [], [], [], 0
        for i, j, written in edits:
            parts += [self.text[last:i], written]
            starts += [self.starts[last:i], np.full(len(written), self.starts[i])]
            ends += [self.ends[last:i], np.full(len(written), self.ends[j - 1])]
            last = j
        parts.append(self.text[last:])
        return Traced("".join(parts), np.concatenate([*starts, self.starts[last:]]), np.concatenate([*ends, self.ends[last:]]))

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])


def strange_signs(text: str) -> set[str]:
    """The disguised characters of a text."""
    return set() if text.isascii() else signs().keys() & set(text)


def plain_signs(traced: Traced) -> Traced:
    met = strange_signs(traced.text)
    if not met:
        return traced
    table, pattern = signs(), re.compile("[" + "".join(map(re.escape, sorted(met))) + "]")
    return traced.rewritten([(m.start(), m.end(), table[m.group()]) for m in pattern.finditer(traced.text)])


DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
# At least four spelled digits, signs or groups of digits, the first of them spelled.
SPELLED_RUN = re.compile(rf"\b(?:plus[\s,-]+)?{DIGIT_WORD}(?:[\s,-]+(?:{DIGIT_WORD}|{DOT_WORDS}|[0-9]+)){{3,}}\b", re.IGNORECASE)
SPELLED_PART = re.compile(r"[^\W\d_]+|[0-9]+")
SPELLED_SIGN = {"plus": "+"} | dict.fromkeys(DOT_WORDS.split("|"), ".") | SPELLED


def spelled_digits(traced: Traced) -> Traced:
    edits = []
    for run in SPELLED_RUN.finditer(traced.text):
        last = run.start()
        for part in SPELLED_PART.finditer(run.group()):
            start, end = run.start() + part.start(), run.start() + part.end()
            if start > last:
                edits.append((last, start, ""))
            written = SPELLED_SIGN.get(part.group().lower())
            if written is not None:
                edits.append((start, end, written))
            last = end
    return traced.rewritten(edits) if edits else traced


BRACKETED = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*({AT_WORDS}|{DOT_WORDS}|@|\.)\s*[\])}}>]\s*", re.IGNORECASE)
# Words that are no domain names after a bare `at` (`look at the dot com boom`).
DETERMINERS = frozenset(("the", "a", "an", "this", "that", "each", "every"))


class Spoken:
    """The words of one language: `name at domain dot ending`."""

    def __init__(self, at: str, dot: str):
        self.plain = "at" in at.split("|")  # a word of prose too: it needs a spoken dot behind it
        self.at = re.compile(rf"\s(?:{at})\s", re.IGNORECASE)
        self.worded = re.compile(rf"(?<=[A-Za-z0-9])(\s+(?:{at})\s+|\s*@\s*)([A-Za-z0-9-]+(?:(?:\s+(?:{dot})\s+|\.)[A-Za-z0-9-]+)+)", re.IGNORECASE)
        self.dots = re.compile(rf"\s+(?:{dot})\s+", re.IGNORECASE)
        self.name_dots = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{dot})\s+(?=[A-Za-z0-9._%+-]+(?:@|\s+(?:{dot})\s))", re.IGNORECASE)

    def rewritten(self, traced: Traced) -> Traced:
        if "@" not in traced.text and not self.at.search(traced.text):
            return traced
        edits, own = [], self.plain
        for match in self.worded.finditer(traced.text):
            spoken = list(self.dots.finditer(match.group(2)))
            if "@" not in match.group(1):
                if self.plain and (not spoken or match.group(2).split(None, 1)[0].lower() in DETERMINERS):
                    continue  # `at example.com` in prose names a place, not a mailbox
                own = True
            edits.append((match.start(1), match.end(1), "@"))
            edits += [(match.start(2) + m.start(), match.start(2) + m.end(), ".") for m in spoken]
        traced = traced.rewritten(edits) if edits else traced
        # Dots in names: `point` and `punto` are words of prose, so they count only in texts that speak their at.
        edits = [(m.start(), m.end(), ".") for m in self.name_dots.finditer(traced.text)] if own and "@" in traced.text else []
        return traced.rewritten(edits) if edits else traced


LANGUAGES = tuple(Spoken(at, dot) for at, dot in AT_AND_DOT)


def sign_of(match: re.Match[str]) -> str:
    return "@" if match.group(1).lower() in (*AT_WORDS.split("|"), "@") else "."


def at_and_dot(traced: Traced) -> Traced:
    """Bracketed disguises anywhere; bare words only in the form `name at domain dot ending`, all in one language."""
    edits = [(m.start(), m.end(), sign_of(m)) for m in BRACKETED.finditer(traced.text)]
    traced = traced.rewritten(edits) if edits else traced
    for language in LANGUAGES:
        traced = language.rewritten(traced)
    return traced


BRACKET_HINT = re.compile(rf"[\[({{<]\s*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*[\])}}>]")
WORD_HINTS = ("dot", "punkt", "arroba", "arobas")
AT_HINT = re.compile(r"\s@|@\s")
WORDS = re.compile(r"[^\W_]+")
# A spelled digit, and three words that are digits, spelled or not, or signs.
RUN_HINT = re.compile("d[dn]{3}")


def hinted(text: str) -> bool:
    """True wherever the transducers of spelled digits and signs match anything."""
    lower = text.casefold()
    if any(word in lower for word in WORD_HINTS) or ("@" in text and AT_HINT.search(text)) or BRACKET_HINT.search(lower):
        return True
    words = WORDS.findall(lower)
    if SPELLED.keys().isdisjoint(words):
        return False
    marks = "".join(["d" if w in SPELLED else "n" if w.isdigit() or w in SPELLED_SIGN else " " for w in words])
    return bool(RUN_HINT.search(marks))


def disguised(text: str) -> dict[str, list[Span]]:
    """Source spans per kind of what the patterns find only in the rewritten text."""
    if not strange_signs(text) and not hinted(text):
        return {}
    traced = at_and_dot(spelled_digits(plain_signs(Traced(text))))
    if traced.text == text:
        return {}
    found = {}
    for kind, detector in DETECTORS.items():
        spans = [(span, traced.source(span)) for span in detector(traced.text)]
        found[kind] = [source for span, source in spans if text[slice(*source)] != traced.text[slice(*span)]]
    return found


def spans_of(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) per kind, by start."""
    base = {kind: detector(text) for kind, detector in DETECTORS.items()}
    extra = disguised(text)
    whole = {}
    for kind in KINDS:
        fresh = extra.get(kind, [])
        if fresh and base[kind]:
            starts = np.array([s for s, _ in base[kind]])
            ends = np.array([e for _, e in base[kind]])
            # Base spans do not overlap, so only the last that starts by s can contain a span.
            fresh = [(s, e) for s, e in fresh if not (i := np.searchsorted(starts, s, side="right")) or ends[i - 1] < e]
        whole[kind] = sorted(base[kind] + fresh)
    return base, whole


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


def redacted(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of the first in it."""
    spans = sorted((start, end, kind) for kind, found in spans_of(text)[1].items() for start, end in found)
    parts, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            parts += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


SCHEMA = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many the rewriting added."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base, whole = spans_of(text or "")
                counts = [len(base[kind]) for kind in KINDS]
                added = sum(map(len, whole.values())) - sum(counts)
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(whole), added))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced in `text` and `n_chars`, if there is such a column, counted anew; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    out = documents.withColumn("text", clean("text"))
    if "n_chars" not in documents.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
