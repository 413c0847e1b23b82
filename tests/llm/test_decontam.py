import re
from collections import Counter

import pytest
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import decontam
from tidelog.llm.common import table

ITEM = "Tom Baker has 12 apples and buys 7 more apples at the market on Friday. How many apples does Tom Baker have after giving 3 kg of them to Anna?"
OTHER = "Priya has 31 apples and buys 5 more apples at the market on Sunday. How many apples does Priya have after giving 2 lbs of them to Jorge?"
BROKEN = "Priya has 31 apples and buys 5 more apples at the market on Sunday. How many apples does Jorge have after giving 2 lbs of them to Jorge?"


def template(text):
    """The template tokens, written plainly."""
    text = re.sub(r"(?<=[0-9])(?=[A-Za-z%°])", " ", text)
    tokens, begins, last, spelled = [], True, "", False
    for line in text.split("\n"):
        begins = True
        for raw in line.split():
            word = re.sub(r"^[^\w$€£%°+-]+|[^\w%°]+$", "", raw)
            ends = raw[-1] in ".!?:" or (word and raw[-2:-1] in list(".!?"))
            if not word:
                begins = begins or bool(ends)
                continue
            lower = word.lower()
            if re.fullmatch(r"[+-]?[$€£]?[0-9]+(?:[.,:/][0-9]+)*", word) or lower in decontam.NUMBER_WORDS:
                kind = "<num>"
            elif lower in decontam.UNITS and last == "<num>":
                kind = "<unit>"
            elif word[0].isupper() and not word.isupper() and not begins:
                kind = "<name>"
            else:
                kind = lower
            number_word = lower in decontam.NUMBER_WORDS
            if not (kind == "<name>" and last == "<name>") and not (number_word and spelled):
                tokens.append(kind)
            last, begins, spelled = kind, bool(ends), number_word
    return tokens


def windows(text):
    """(place, window) of the template windows."""
    tokens = template(text)
    found = [(i, tuple(tokens[i : i + 5])) for i in range(len(tokens) - 4)]
    return [(i, w) for i, w in found if sum(t not in decontam.PLACEHOLDERS for t in w) >= 3]


def plain_leaks(texts, items):
    """Every text against every item, along the alignment with most windows."""
    wanted = {}
    for key, text in items:
        for i, w in windows(text or ""):
            wanted.setdefault(key, {}).setdefault(w, i)
    found = {}
    for key, text in texts:
        mine = windows(text or "")
        for item, goal in wanted.items():
            met = [(i - goal[w], w) for i, w in mine if w in goal]
            if met:
                count = Counter(d for d, _ in met)
                best = min(count, key=lambda d: (-count[d], d))
                matched = len({w for d, w in met if abs(d - best) <= decontam.DRIFT})
                if matched >= 0.8 * len(goal):
                    found[key, item] = (len(goal), matched)
    return found


def rows_of(spark, documents, texts, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as hash", "2 as slots")
    return decontam.op3(documents(texts).selectExpr("*", "1 as pos", "'x' as row_key", "3 as item_id"), benchmark).collect()


def test_table(spark):
    documents, benchmark = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "benchmark"))
    texts = [tuple(row) for row in documents.select("doc_id", "text").collect()]
    items = [tuple(row) for row in benchmark.select("item_id", "text").collect()]
    rows = decontam.op3(documents, benchmark).collect()
    found = {(row.doc_id, row.item_id): (row.n_windows, row.n_matched) for row in rows}
    assert found == plain_leaks(texts, items)  # no item of the table has contradicting slots
    assert found


def test_templates_of_texts(spark):
    canonical = decontam.Canonical()
    for text in (ITEM, OTHER, "A 5kg bag.\nThe Red fox, e.g. Mr. X | costs $3.50! Then", "", "  \n ", "ONE two 3 KM away. $ % +", "He (Anna) said: Go home"):
        codes, slot, _, _ = canonical.template(text)
        plain = template(text)
        assert len(codes) == len(plain)
        assert slot.tolist() == [t in decontam.PLACEHOLDERS for t in plain]
        assert len(canonical.windows(text)) == len([1 for i in range(len(plain) - 4) if sum(t not in decontam.PLACEHOLDERS for t in plain[i : i + 5]) >= 3])


@pytest.mark.parametrize("lead", ["", "Some words before it. ", "word " * 5000])
def test_reparameterised(spark, documents, lead):
    texts = [(1, f"{lead}{ITEM} And more"), (2, f"{lead}{OTHER} and more"), (3, f"{lead}{BROKEN}"), (4, f"{lead}nothing of the kind is in this one here"), (5, ITEM[:70])]
    found = {row.doc_id: row.kind for row in rows_of(spark, documents, texts, [(9, ITEM), (8, "too short"), (7, None)])}
    found.pop(3, None)  # mostly consistent: either verdict is defined by the share
    assert found == {1: "exact", 2: "reparameterised"}


def test_scattered_windows_are_no_copy(spark, documents):
    words = ITEM.split()
    scattered = " ".join(" ".join(words[i : i + 5]) + f" filler{i} of another sort" for i in range(len(words) - 4))
    apart = " ".join(words[:20]) + " a few words more " + " ".join(words[20:])
    # First a part of the item, then all of it.
    later = " ".join(words[:15]) + " and so on " + "word " * 100 + ITEM
    rows = rows_of(spark, documents, [(1, scattered), (2, later), (3, apart)], [(9, ITEM)])
    assert {row.doc_id for row in rows if row.doc_id < 3} == {2}


def test_items_by_id_and_text(spark, documents):
    second = "the wizard saw the old dwarf near the river by the tower and went away without a word to him"
    rows = rows_of(spark, documents, [(1, ITEM), (2, second)], [(9, ITEM), (9, second), (None, second), (9, ITEM)])
    assert sorted(((row.doc_id, row.item_id) for row in rows), key=str) == [(1, 9), (2, 9), (2, None)]


def test_spelled_numbers_in_a_row(spark, documents):
    item = "the farmer sold twenty five sheep at the old market and then bought one hundred and six geese there"
    other = "the farmer sold nine sheep at the old market and then bought eighty four and two geese there"
    assert [row.kind for row in rows_of(spark, documents, [(1, f"so {other} again")], [(9, item)])] == ["reparameterised"]


def test_contradicting_slots(spark, documents):
    item = "the wizard Anna met the dwarf Anna and the troll Anna near the river Anna by the tower Anna today"
    good = item.replace("Anna", "Berta")
    bad = item.replace("Anna", "{}").format("Berta", "Carla", "Dora", "Emma", "Frida")
    found = {row.doc_id: row.kind for row in rows_of(spark, documents, [(1, good), (2, bad), (3, item)], [(5, item)])}
    assert found == {1: "reparameterised", 3: "exact"}


def test_copies_that_templates_do_not_show(spark, documents):
    dense = "Compute 12 + 30 * 4 - 7 now please"
    names = "We saw Anna Berg and Carl Dietz with Emma Fuchs and Gerd Hahn near Ida Jung last week"
    texts = [(1, f"Before it. {dense} and after it"), (2, f"x {names.lower()} y"), (3, f"x {names.upper()} y"), (4, ITEM.upper()), (5, "Compute the sum of it now please, and more words"), (6, names)]
    rows = rows_of(spark, documents, texts, [(7, dense), (8, names), (9, ITEM)])
    assert sorted((row.doc_id, row.item_id, row.kind) for row in rows) == [(1, 7, "exact"), (2, 8, "exact"), (3, 8, "exact"), (4, 9, "exact"), (6, 8, "exact")]
    benchmark = spark.createDataFrame([(7, dense), (8, names), (9, ITEM)], "item_id long, text string")
    assert [row.doc_id for row in decontam.clean_documents(documents(texts), benchmark).collect()] == [5]


def test_odd_rows(spark, documents):
    texts = [(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM), (3, "other text under the same id that is long enough")]
    found = [(row.doc_id, row.item_id) for row in rows_of(spark, documents, texts, [(9, ITEM), (10, ITEM)])]
    assert sorted(found, key=str) == [(3, 10), (3, 9), (None, 10), (None, 9)]
    benchmark = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    kept = decontam.clean_documents(documents(texts).selectExpr("*", "1 as held_key", "2 as __row_key", "3 as key", "4 as row"), benchmark)
    assert {"held_key", "__row_key", "key", "row"} <= set(kept.columns)
    kept = kept.drop("held_key", "__row_key", "key", "row")
    assert sorted(str(row.doc_id) for row in kept.collect()) == ["1", "2", "3"]
    assert kept.columns == documents(texts).columns
    assert decontam.op3(documents([]), benchmark).count() == 0
    assert decontam.op3(documents(texts), benchmark.limit(0)).count() == 0
