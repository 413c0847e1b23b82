"""Ranked lexical search over posting lists that are blocked by document similarity.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A document's score for an item is the
sum, over the item's distinct terms, of weight * ((10^9 * tf) div (1000 * tf + 8 * m)), with weight = floor(1000 *
ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L: whole numbers throughout, so that ties are ties.

The documents' terms are counted once and written to the shared folder, restricted to the terms that items ask for (other
terms add nothing to a score, though they count for N, L and n). Tasks then index their documents, a shard at a time:

- Documents get a sketch, a signed random projection of their weighted terms. Each term's posting list is cut into geometric
  blocks: the documents nearest to the same one of some documents of the list.
- A block keeps a summary, the largest impact of any of its documents in each coordinate that an item asks for together
  with the term.
- An item's terms are read from the heaviest to the lightest. A block is skipped only if the bound from its summary, over the
  terms not yet read, lies below the score of the last of the best documents so far (a document with one of the terms
  read before was either scored or lay in a block skipped before). All documents of other blocks are scored exactly. The
  item ends when the bound over whole lists falls below that score.

The best documents of each task meet in one window per item, at most `top` rows per item and task. Items are taken in blocks
of about ITEM_BYTES of text, so what is sent to tasks does not grow with the items; each block of items reads the documents
once.

Nulls: a null text has no terms; such documents count for nothing and such items get no rows. A null doc_id keeps its row and
sorts first; a null item_id is an item of its own. Repeated documents are documents each. Repeated items get their rows as
often as they stand there. Extra columns are ignored. Texts count whole. No documents or no items: an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved

TOP = 10
# Bytes of item texts whose terms go to the tasks together.
ITEM_BYTES = 128 << 10
# Cells (documents x terms) that a shard lays out densely.
CELLS = 16 << 20
# Documents that a block aims at, and the most blocks of a list of a shard.
BLOCK = 32
BLOCKS = 64
# Dimensions of a document's sketch.
SKETCH = 16

BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode().translate(BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Questions:
    """The items of a block as rows of term numbers; a lower number is a heavier term."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place, self.weights = place, weights[order]
        worth = int((self.weights > 0).sum())
        self.items = [np.sort(place[i]) for i in items]
        self.items = [i[i < worth] for i in self.items]
        # Per term, the terms that an item reads together with it or after it: the coordinates of its summaries.
        asked: list[list[np.ndarray]] = [[] for _ in weights]
        for item in self.items:
            for at, term in enumerate(item.tolist()):
                asked[term].append(item[at:])
        self.coordinates = [np.unique(np.concatenate(a)) if a else np.empty(0, np.int64) for a in asked]
        self.columns = [[np.searchsorted(self.coordinates[t], item[at:]) for at, t in enumerate(item.tolist())] for item in self.items]


class Shard:
    """Documents side by side: impacts, sketches, and per term the blocks with their summaries, made when first read."""

    def __init__(self, questions: Questions, signs: np.ndarray, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.questions = questions
        self.impacts = np.zeros((size, len(questions.weights)), np.int32)
        self.impacts[rows, terms] = impacts
        self.highest = self.impacts.max(axis=0).astype(np.int64)
        self.sketch = np.zeros((size, SKETCH), np.float32)
        value = (impacts * questions.weights[terms]).astype(np.float32)
        for axis in range(SKETCH):
            self.sketch[:, axis] = np.bincount(rows, weights=value * signs[terms, axis], minlength=size)
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        self.postings = rows[order]
        self.first = np.searchsorted(terms[order], np.arange(len(questions.weights) + 1))
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seen = self.skipped = 0

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by block, first place of each block and the end, summary of each block)."""
        found = self.made.get(term)
        if found is None:
            listed = self.postings[self.first[term] : self.first[term + 1]]
            count = min(BLOCKS, -(-len(listed) // BLOCK))
            centres = listed[np.arange(count) * len(listed) // count]
            nearest = np.argmax(self.sketch[listed] @ self.sketch[centres].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            listed, nearest = listed[order], nearest[order]
            starts = np.flatnonzero(np.concatenate(([True], nearest[1:] != nearest[:-1])))
            summary = np.maximum.reduceat(self.impacts[np.ix_(listed, self.questions.coordinates[term])], starts, axis=0)
            found = self.made[term] = listed, np.append(starts, len(listed)), summary
        return found

    def search(self, number: int, best: Best) -> None:
        item, columns = self.questions.items[number], self.questions.columns[number]
        weights = self.questions.weights[item]
        rest = np.cumsum((self.highest[item] * weights)[::-1])[::-1].tolist()
        scored = np.zeros(len(self.impacts), bool)
        for at, term in enumerate(item.tolist()):
            if rest[at] < best.least:
                break
            if self.first[term] == self.first[term + 1]:
                continue
            listed, starts, summary = self.blocks(term)
            bounds = summary[:, columns[at]] @ weights[at:]
            open_ = bounds >= best.least
            self.seen += len(open_)
            if not open_.all():
                self.skipped += int((~open_).sum())
                listed = listed[np.repeat(open_, np.diff(starts))]
            listed = listed[~scored[listed]]
            if len(listed):
                scored[listed] = True
                best.add(self.impacts[np.ix_(listed, item)] @ weights, listed)


class Best:
    """The best documents of an item so far; `least` is the score that a further document must reach."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.named = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.shard_ids: np.ndarray = self.ids
        self.shard_named: np.ndarray = self.named

    def add(self, scores: np.ndarray, documents: np.ndarray) -> None:
        good = scores >= self.least
        scores, documents = scores[good], documents[good]
        if not len(scores):
            return
        scores = np.concatenate((self.scores, scores))
        ids = np.concatenate((self.ids, self.shard_ids[documents]))
        named = np.concatenate((self.named, self.shard_named[documents]))
        order = np.lexsort((named, ids, -scores))[: self.top]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def forward(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """id, named (whether there is a doc_id), n, and the numbers and frequencies of the vocabulary's terms, of every document that has any term."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # at most the terms of ITEM_BYTES of text

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {term: i for i, term in enumerate(sent.value)}
        for frame in frames:
            rows = []
            for key, named, text in zip(frame["id"], frame["named"], frame["text"], strict=True):
                terms = terms_of(text)
                if terms:
                    held, times = np.unique(np.fromiter((number[t] for t in terms if t in number), np.int32), return_counts=True)
                    rows.append((key, named, len(terms), held, times.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["id", "named", "n", "terms", "times"])

    held = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("doc_id").isNotNull().alias("named"), "text")
    return held.mapInPandas(count, "id long, named boolean, n long, terms array<int>, times array<int>")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, cells: int = CELLS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every item."""
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    asked = saved(asked.withColumn("place", F.xxhash64("item_id", "text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod("place", F.lit(blocks)) == block).select(F.col("item_id").cast("string"), "text", "copies").collect()
        if rows:
            found.append(_block(documents, rows, top, cells))
    if not found:
        empty = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
        return empty.withColumn("item_id", F.col("item_id").cast(kind))
    return reduce(DataFrame.union, found).withColumn("item_id", F.col("item_id").cast(kind))


def _block(documents: DataFrame, rows: list, top: int, cells: int) -> DataFrame:
    """The result for some items, read from all documents."""
    spark = documents.sparkSession
    number: dict[bytes, int] = {}
    items = [[number.setdefault(term, len(number)) for term in dict.fromkeys(terms_of(row.text))] for row in rows]
    counted = saved(forward(documents, list(number)), "terms")
    n_documents, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(number), np.int64)
    for term, held in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = held
    weights = np.array([weight(n_documents, held) for held in holding.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((items, weights, [(row.item_id, row.copies) for row in rows]))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights, names = sent.value
        questions = Questions(items, weights)
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (len(weights), SKETCH))
        bests = [Best(top) for _ in items]
        size = max(64, cells // max(1, len(weights)))
        for frame in frames:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                held = part["terms"].str.len().to_numpy(np.int64)
                if not held.any():
                    continue
                terms = questions.place[np.concatenate(part["terms"].to_numpy())]
                times = np.concatenate(part["times"].to_numpy()).astype(np.int64)
                lengths = [10 + 90 * n * n_documents // n_terms for n in part["n"].tolist()]
                row = np.repeat(np.arange(len(part)), held)
                impacts = 1_000_000_000 * times // (1000 * times + 8 * np.array(lengths, np.int64)[row])
                shard = Shard(questions, signs, row, terms, impacts, len(part))
                ids, named = part["id"].to_numpy(np.int64), part["named"].to_numpy(bool)
                for i, own in enumerate(bests):
                    own.shard_ids, own.shard_named = ids, named
                    shard.search(i, own)
        out = [(i, *names[i], s, key, known) for i, b in enumerate(bests) for s, key, known in zip(b.scores.tolist(), b.ids.tolist(), b.named.tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["item", "item_id", "copies", "score", "id", "named"])

    found = counted.mapInPandas(best, "item int, item_id string, copies long, score long, id long, named boolean")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id", "named"))
    found = found.withColumn("rank", place).where(F.col("rank") <= top)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("named"), F.col("id")).alias("doc_id"), "score")


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
with words as (select doc_id, unnest({TERMS_SQL}) as term from documents),
held as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as all_terms from sizes),
weights as (
    select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
    from held, totals group by term
),
lengths as (select doc_id, 10 + (90 * n * docs) // all_terms as m from sizes, totals),
asked as (select distinct item_id, unnest({TERMS_SQL}) as term from benchmark),
scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from asked join weights using (term) join held using (term) join lengths using (doc_id)
    group by item_id, doc_id
),
ranked as (
    select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as place
    from scored where score > 0
)
select item_id, place::integer as rank, doc_id, score from ranked where place <= 10
"""
