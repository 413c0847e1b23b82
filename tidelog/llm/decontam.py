"""Benchmark decontamination by templates: typed placeholders, window joins, slot consistency.

A text becomes a sequence of template tokens: words without the signs around them and in lower case; numbers, units (after
a number) and names (capitalised inside a sentence, but not all in capitals; several in a row are one) become placeholders. Windows of five
template tokens, at least three of them literal, are joined by hash with those of the benchmark items. A document holds
an item if at least 0.8 of the item's distinct windows occur in it side by side and, along the best alignment, at least 0.8 of the slot
occurrences agree with one value per item value: then it is an exact leak (if as many slots hold the item's own values), or
the question with other numbers or names.

Windows of five words as they are, in lower case and without placeholders, are joined likewise: a document that holds at least
0.8 of an item's distinct word windows holds an exact copy, also where the template has no windows (numbers or names too
dense) or others (names in another case). Only pairs that templates do not find are reported by words: with word windows
counted and without slots.

Side by side means: along one alignment of item and document, the one with most windows, give or take DRIFT tokens for
values and insertions of other length. Windows scattered over a text are no copy. Several spelled numbers in a row are one.

Documents are scanned once; a Bloom filter of the benchmark's windows (BLOOM_BITS, whatever the benchmark's size, so it may
let more through but never less) keeps other windows from being shuffled. A document row or item is known by the hash of its id
and text, so rows that share an id are judged apart and repeated rows alike.

Nulls: null texts have no windows; rows and items without an id are judged and reported with a null id. Items with a null or short
text (fewer than five words) have no windows and are never matched. No documents or no items: an empty result, or all documents are clean. Extra columns are ignored. Texts count
whole, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved

WINDOW = 5
LITERALS = 3
SIMILARITY = 0.8
DRIFT = 20
BLOOM_BITS = 1 << 24
# Distinct tokens that a task remembers.
MEMORY = 400_000

# Number words and units of measure.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm m km inch inches in ft foot feet yard yards mile miles mg g gram grams kg kilogram kilograms kilo kilos lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mph kmh km/h % percent degree degrees ° °c °f c f k w kw mw v a hz khz mhz ghz "
    "b kb mb gb tb dollar dollars cent cents euro euros usd eur gbp".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?[0-9]+(?:[.,:/][0-9]+)*")
GLUED = re.compile(r"(?<=[0-9])(?=[A-Za-z%°])")
EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
NUM, CAPITAL, UNIT, ENDS, EMPTY, SPELLED = 1, 2, 4, 8, 16, 32
# Forms of windows: template tokens, words.
TEMPLATE, WORDS = 0, 1
PLACEHOLDERS = ("<num>", "<name>", "<unit>")
SEED = 17
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Canonical:
    """Turns texts into template tokens."""

    def __init__(self) -> None:
        self.placeholder = np.array([xxhash.xxh64_intdigest(p, SEED) for p in PLACEHOLDERS], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.codes, self.flags = np.empty(1024, np.uint64), np.empty(1024, np.uint8)

    def __missing(self, token: str) -> int:
        word = EDGES.sub("", token)
        flags = 0
        if token == "\0":
            flags = ENDS | EMPTY
        elif not word:
            flags = EMPTY | (ENDS if token[-1] in ".!?:" else 0)
        else:
            if token[-1] in ".!?:" or token[-2:-1] in (".", "!", "?"):
                flags |= ENDS
            lower = word.lower()
            if NUMBER.fullmatch(word) or lower in NUMBER_WORDS:
                flags |= NUM | (SPELLED if lower in NUMBER_WORDS else 0)
            elif word[0].isupper() and not word.isupper():
                flags |= CAPITAL
            if lower in UNITS:
                flags |= UNIT
            word = lower
        self.index[token] = at = len(self.index)
        if at == len(self.codes):
            self.codes, self.flags = np.resize(self.codes, 2 * at), np.resize(self.flags, 2 * at)
        self.codes[at], self.flags[at] = xxhash.xxh64_intdigest(word, SEED), flags
        return at

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(code per template token, whether it is a slot, its place among the raw tokens and the end, raw tokens)."""
        return self.parsed(text)[:4]

    def parsed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """What `template` returns, and the code of every word."""
        if len(self.index) > MEMORY:
            self.forget()
        raw = GLUED.sub(" ", text).replace("\n", " \0 ").split()
        index, missing = self.index, self.__missing
        at = np.fromiter((index[t] if t in index else missing(t) for t in raw), np.int64, len(raw))
        flags, codes = self.flags[at], self.codes[at]
        ends = np.concatenate(([0], np.cumsum(flags & ENDS > 0)))
        place = np.flatnonzero(flags & EMPTY == 0)
        flags, codes, ends = flags[place], codes[place], ends[place]
        before = np.concatenate(([-1], ends[:-1]))
        begins = (ends > before) if len(place) else np.zeros(0, bool)
        num = flags & NUM > 0
        after_num = np.concatenate(([False], num[:-1])) if len(place) else num
        unit = (flags & UNIT > 0) & after_num & ~num
        name = (flags & CAPITAL > 0) & ~begins & ~unit
        words = codes
        codes = np.where(num, self.placeholder[0], np.where(name, self.placeholder[1], np.where(unit, self.placeholder[2], codes)))
        spelled = flags & SPELLED > 0
        again = (name[1:] & name[:-1]) | (spelled[1:] & spelled[:-1])
        keep = ~np.concatenate(([False], again)) if len(place) else name
        slot = (num | name | unit)[keep]
        return codes[keep], slot, np.append(place[keep], len(raw)), raw, words

    def windows(self, text: str | None, wanted=None) -> list[tuple[int, int, list[str | None]]]:
        """(position, hash, slot values) of the template windows, those for whose hashes `wanted` (if given) says so."""
        return [window[1:] for window in self.all_windows(text, wanted) if window[0] == TEMPLATE]

    def all_windows(self, text: str | None, wanted=None) -> list[tuple[int, int, int, list[str | None]]]:
        """(form, position, hash, slot values) of the windows of both forms."""
        codes, slot, place, raw, words = self.parsed(text or "")
        found = []
        if len(codes) >= WINDOW:
            hashes = window_hashes(codes, TEMPLATE)
            slots = np.concatenate(([0], np.cumsum(slot)))
            fit = slots[WINDOW:] - slots[:-WINDOW] <= WINDOW - LITERALS
            if wanted is not None:
                fit &= wanted(hashes)
            for i in np.flatnonzero(fit).tolist():
                values = [self.value(raw, place, j) if slot[j] else None for j in range(i, i + WINDOW)]
                found.append((TEMPLATE, i, int(hashes[i].astype(np.int64)), values))
        if len(words) >= WINDOW:
            hashes = window_hashes(words, WORDS)
            fit = range(len(hashes)) if wanted is None else np.flatnonzero(wanted(hashes)).tolist()
            found += [(WORDS, i, int(hashes[i].astype(np.int64)), []) for i in fit]
        return found

    def value(self, raw: list[str], place: np.ndarray, j: int) -> str:
        words = (EDGES.sub("", t).lower() for t in raw[place[j] : place[j + 1]] if t != "\0")
        return " ".join(w for w in words if w)


def window_hashes(codes: np.ndarray, form: int) -> np.ndarray:
    count = len(codes) - WINDOW + 1
    hashes = np.full(count, form, np.uint64)
    for k in range(WINDOW):
        hashes = (hashes ^ codes[k : k + count]) * FACTOR
        hashes ^= hashes >> np.uint64(29)
    return hashes


def bloom_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions per hash."""
    return hashes & np.uint64(BLOOM_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)


def bloom_of(windows: DataFrame) -> np.ndarray:
    """The filter's words; at most BLOOM_BITS / 64 rows of set words come to the driver, whatever the benchmark's size."""
    low = F.col("hash").bitwiseAND(F.lit(BLOOM_BITS - 1))
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(BLOOM_BITS - 1))
    bits = windows.select(F.explode(F.array(low, high)).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("word")
    rows = bits.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).collect()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[[row.word for row in rows]] = np.array([row.mask for row in rows], np.int64).view(np.uint64)
    return words


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, form, off, hash, slots) of the distinct windows of every item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical = Canonical()
        for frame in frames:
            rows = [(*key, *window) for *key, text in zip(frame["item"], frame["item_id"], frame["text"], strict=True) for window in canonical.all_windows(text)]
            yield pd.DataFrame(rows, columns=["item", "item_id", "form", "off", "hash", "slots"])

    found = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), "text")
    found = found.mapInPandas(run, "item long, item_id string, form int, off int, hash long, slots array<string>")
    first = found.groupBy("item", "item_id", "form", "hash").agg(F.min_by(F.struct("off", "slots"), F.struct("off", "slots")).alias("first"))
    return first.select("item", F.col("item_id").cast("long").alias("item_id"), "form", "hash", "first.off", "first.slots")


def document_windows(documents: DataFrame, bloom: np.ndarray) -> DataFrame:
    """(row_key, doc_id, form, pos, hash, slots) of the windows that may be the benchmark's."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom)  # BLOOM_BITS / 8 bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, canonical = shared.value, Canonical()

        def wanted(hashes: np.ndarray) -> np.ndarray:
            # The second bit is looked up only where the first is set.
            met = np.zeros(len(hashes), bool)
            at = np.arange(len(hashes))
            for place in bloom_places(hashes):
                place = place[at]
                at = at[(words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            met[at] = True
            return met

        for frame in frames:
            rows = []
            for key, doc_id, text in zip(frame["row_key"], frame["doc_id"], frame["text"], strict=True):
                rows += [(key, doc_id, *window) for window in canonical.all_windows(text, wanted)]
            yield pd.DataFrame(rows, columns=["row_key", "doc_id", "form", "pos", "hash", "slots"])

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = keyed.mapInPandas(run, "row_key long, doc_id string, form int, pos int, hash long, slots array<string>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, doc_id, item_id, n_windows, n_matched, similarity, n_slots, consistency, kind) of each item a row holds."""
    items = saved(item_windows(benchmark), "benchmark-windows")
    found = document_windows(documents, bloom_of(items))
    sizes = items.groupBy("item", "form").agg(F.count("*").alias("n_windows"))
    item = items.select("item", "form", "off", "hash", F.col("slots").alias("item_slots"))
    met = found.join(item, ["form", "hash"]).withColumn("diagonal", F.col("pos") - F.col("off"))
    met = saved(met.distinct(), "matched-windows")
    # One alignment per row, item and form: the one with most windows, of several the first.
    pair = ["row_key", "item", "form"]
    aligned = met.groupBy(*pair, "diagonal").agg(F.count("*").alias("n"))
    best = aligned.groupBy(*pair).agg(F.max_by("diagonal", F.struct("n", -F.col("diagonal"))).alias("best"))
    met = met.join(best, pair).where(F.abs(F.col("diagonal") - F.col("best")) <= DRIFT)
    matched = met.select(*pair, "doc_id", "hash").distinct().groupBy(*pair, "doc_id").agg(F.count("*").alias("n_matched"))
    matched = matched.join(sizes, ["item", "form"]).withColumn("similarity", F.col("n_matched") / F.col("n_windows")).where(F.col("similarity") >= SIMILARITY)
    by_words, matched = matched.where(F.col("form") == WORDS), matched.where(F.col("form") == TEMPLATE)
    pairs = met.where((F.col("form") == TEMPLATE) & (F.col("diagonal") == F.col("best")))
    pairs = pairs.select("row_key", "item", F.explode(F.arrays_zip("item_slots", F.col("slots").alias("doc_slots"))).alias("pair"))
    pairs = pairs.where("pair.item_slots is not null").groupBy("row_key", "item", "pair.item_slots", "pair.doc_slots").agg(F.count("*").alias("n"))
    values = pairs.groupBy("row_key", "item", "item_slots").agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("item_slots") == F.col("doc_slots"), F.col("n")).otherwise(0)).alias("equal")
    )
    slots = values.groupBy("row_key", "item").agg(F.sum("n").alias("n_slots"), F.sum("most").alias("agree"), F.sum("equal").alias("equal"))
    judged = matched.join(slots, ["row_key", "item"], "left").na.fill(0, ["n_slots", "agree", "equal"])
    judged = judged.withColumn("consistency", F.when(F.col("n_slots") == 0, 1.0).otherwise(F.col("agree") / F.col("n_slots")))
    kind = F.when(F.col("equal") >= SIMILARITY * F.col("n_slots"), "exact").otherwise("reparameterised")
    columns = ["row_key", "doc_id", "item", "n_windows", "n_matched", "similarity", "n_slots", "consistency", "kind"]
    judged = saved(judged.where(F.col("consistency") >= SIMILARITY).withColumn("kind", kind).select(*columns), "template-leaks")
    by_words = by_words.join(judged.select("row_key", "item"), ["row_key", "item"], "left_anti")
    by_words = by_words.withColumn("n_slots", F.lit(0).cast("long")).withColumn("consistency", F.lit(1.0)).withColumn("kind", F.lit("exact"))
    named = items.select("item", "item_id").distinct()
    return judged.unionByName(by_words.select(*columns)).join(named, "item").drop("item")


def op3(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return leaks(documents, benchmark).drop("row_key").distinct()


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    # Written, so that its size is known: a few rows are sent to the documents, which then stay where they are.
    held = saved(leaks(documents, benchmark).select(F.col("row_key").alias("key")).distinct(), "held-items")
    # The rows are carried as one column, so that no name of theirs can clash.
    keyed = documents.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(held, "key", "left_anti").select("row.*")
