"""Language-model scoring with a weighted backoff automaton.

States are the contexts of a smoothed n-gram model (the empty one, words, and so on up to order - 1 words). A state has an
arc for every n-gram seen in training, weighted with log10 of

    p(w | h) = (c(hw) + MU * p(w | h')) / (c(h) + MU),     p(w) = (c(w) + ADD) / (N + ADD * (V + 1)),

h' being h without its first word, and one failure arc to the state of h', weighted with log10(MU / (c(h) + MU)). Following
failure arcs until an arc for the next word is found gives exactly the smoothed probability, and the probabilities of a
state add up to one. A text is read once from left to right with the state carried along: after a word that an arc from a
context of k words was found for, the state is the context of k + 1 words that ends with it (longer ones were never seen).
The texts of a block are read side by side, a step of arrays per place; a state depends on the words before it only,
so long texts are cut into segments that begin in the longest context, whose unseen part fails at no cost.

The model is never gathered in one place. Documents that follow each other make blocks of about BLOCK_BYTES, which travel
compressed as one. Each block counts its own n-grams (by 64-bit hash) and sends the sorted counts, cut into hash ranges and written
as steps from hash to hash, to the ranges' tasks; these add them up and
send back to each block only the totals that differ from its own counts, with a bit per entry that says which. With those a block builds its part of the
automaton: the arcs its texts can reach. Counts are added up before every shuffle, so a frequent word is one entry per
block, and no task holds more than a block or a range.

Training documents are those with crc32(doc_id as text) mod 10 <> 0 (a null id counts as the empty text, remainder 0).
Nulls: a null text is empty and is scored as the end token alone. Repeated rows stay and count each. Extra columns are
ignored. Texts count whole, of any length. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 3
MU = 4.0
ADD = 0.1
BLOCK_BYTES = 6 << 20
# How hard a block's texts are compressed, and the byte between them, which is in no text.
LEVEL = 9
BREAK = b"\xff"
# Events of a text that are read in one go.
SEGMENT = 512
SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(mark, 7)) for mark in (b" begin", b" end"))  # no word holds a space
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 10 == 0


class Block:
    """The token events of a block of texts: words and one end per text, and the n-grams that end at each."""

    def __init__(self, texts: list[str | bytes | None], trained: np.ndarray, order: int):
        vocabulary: dict[bytes, int] = {}
        known = vocabulary.setdefault
        ids = []
        for text in texts:
            words = (text if isinstance(text, bytes) else (text or "").encode()).lower().split()
            ids.append(np.fromiter((known(w, len(vocabulary)) for w in words), np.int64, len(words)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in vocabulary), np.uint64, len(vocabulary))
        self.sizes = np.array([len(i) + 1 for i in ids], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        token = np.empty(total, np.uint64)
        for start, own in zip(self.first.tolist(), ids, strict=True):
            token[start : start + len(own)] = hashes[own]
            token[start + len(own)] = END
        weight = np.repeat(trained, self.sizes)
        behind = np.arange(total) - np.repeat(self.first, self.sizes)  # events of the text before this one
        # context[t]: hash of the (k - 1)-gram before event t, which may begin with BEGIN.
        context = np.concatenate(([BEGIN], token[:-1])) if total else token
        context = np.where(behind == 0, BEGIN, context)
        self.unique: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.context: list[np.ndarray | None] = [None]
        self.deep = [np.ones(total, bool)]
        grams = token
        for k in range(1, order + 1):
            if k > 1:
                self.deep.append(behind >= k - 2)  # BEGIN stands before the first event
                # Events too near the beginning end no k-gram: the text before this one, whichever it is, is not looked at.
                grams = np.where(self.deep[-1], self._joined(context, token, k), np.uint64(0))
                self.context.append(context)
                context = np.concatenate(([BEGIN], grams[:-1])) if total else grams
            unique, at = np.unique(grams, return_inverse=True)
            self.unique.append(unique)
            self.at.append(at)
            self.count.append(np.bincount(at, weights=weight & self.deep[-1], minlength=len(unique)).astype(np.int64))

    @staticmethod
    def _joined(context: np.ndarray, token: np.ndarray, k: int) -> np.ndarray:
        mixed = (context ^ (context >> np.uint64(31)) ^ np.uint64(k)) * FACTOR
        mixed = (mixed ^ token) * FACTOR
        return mixed ^ (mixed >> np.uint64(29))


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all highest bytes first, without the planes that are zero throughout.

    Planes are compressed one by one from the highest on, until one does not shrink: it and those below are as good as random.
    Ahead of them: how many numbers and planes there are, and the sizes of the compressed planes.
    """
    values = np.ascontiguousarray(values, np.uint64)
    used = (int(values.max(initial=0)).bit_length() + 7) // 8
    rows = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :used].T[::-1])
    small: list[bytes] = []
    for row in rows:
        packed = zstandard.compress(row.tobytes(), 1)
        if len(packed) >= len(row):
            break
        small.append(packed)
    head = struct.pack(f"<IBB{len(small)}I", len(values), used, len(small), *map(len, small))
    return b"".join([head, *small, rows[len(small) :].tobytes()])


def numbers(packed: bytes) -> np.ndarray:
    count, used, small = struct.unpack_from("<IBB", packed)
    sizes = struct.unpack_from(f"<{small}I", packed, 6)
    at = 6 + 4 * small
    out = np.zeros((count, 8), np.uint8)
    for plane in range(used):
        size = sizes[plane] if plane < small else count
        row = packed[at : at + size]
        out[:, used - 1 - plane] = np.frombuffer(zstandard.decompress(row) if plane < small else row, np.uint8)
        at += size
    return out.view(np.uint64).ravel()


def borders(parts: int) -> np.ndarray:
    """The least hash of each of `parts` equal ranges."""
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of hashes begins in the sorted `hashes`."""
    return np.append(np.searchsorted(hashes, borders(parts)), len(hashes))


class Automaton:
    """Arc and failure weights for what one block can reach."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, words: int, mu: float = MU, add: float = ADD):
        self.block, self.counts = block, counts
        end = np.searchsorted(block.unique[0], END)
        probability = (counts[0] + add) / (tokens + add * (words + 1))
        self.arc = [np.log10(probability)]
        self.failure: list[np.ndarray | None] = [None]
        for k in range(1, len(counts)):
            # Of each n-gram any event that it ends at tells its context and its lower n-gram.
            sample = np.zeros(len(counts[k]), np.int64)
            sample[block.at[k]] = np.arange(len(block.at[k]))
            context = self._context_counts(k, sample, end)
            probability = (counts[k] + mu * probability[block.at[k - 1][sample]]) / (context + mu)
            self.arc.append(np.log10(probability))
            self.failure.append(np.log10(mu / (context + mu)))

    def _context_counts(self, k: int, sample: np.ndarray, end: int) -> np.ndarray:
        """How often the context of each (k + 1)-gram was followed by anything in training."""
        context, below = self.block.context[k][sample], self.block.unique[k - 1]
        place = np.minimum(np.searchsorted(below, context), len(below) - 1)
        counts = np.where(below[place] == context, self.counts[k - 1][place], 0)
        return np.where(context == BEGIN, self.counts[0][end], counts) if k == 1 else counts

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """(base, model) log10 probability of every event, from one traversal of the texts."""
        block, deepest = self.block, len(self.counts) - 1
        base, weight = self.arc[0][block.at[0]], np.zeros(len(block.at[0]))
        # Segments of the texts, the longest first.
        pieces = -(-block.sizes // SEGMENT)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(block.first, pieces) + number * SEGMENT
        size = np.minimum(np.repeat(block.first + block.sizes, pieces) - start, SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        # The words of a segment's context: the beginning of a text is a context of one.
        state = np.where(number[order] == 0, min(1, deepest), deepest)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, side="left"))  # segments longer than `step`
            at, level, score = start[:live] + step, state[:live].copy(), np.zeros(live)
            for k in range(deepest, 0, -1):
                here = np.flatnonzero(level == k)
                if len(here):
                    gram = block.at[k][at[here]]
                    known = self.counts[k][gram] > 0
                    score[here] += np.where(known, self.arc[k][gram], self.failure[k][gram])
                    level[here[~known]] = k - 1
            weight[at] = np.where(level == 0, score + base[at], score)
            state[:live] = np.minimum(level + 1, deepest)
        return base, weight


def blocks_of(documents: DataFrame, block_bytes: int) -> DataFrame:
    """block, doc_ids and texts, compressed as one, of about `block_bytes` of texts that follow each other in an input partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        keys: list[str | None] = []
        texts: list[bytes] = []

        def row() -> pd.DataFrame:
            nonlocal made, size
            block = task << 32 | made
            out = pd.DataFrame([(block, keys.copy(), zstandard.compress(BREAK.join(texts), LEVEL))], columns=["block", "doc_ids", "texts"])
            keys.clear()
            texts.clear()
            made, size = made + 1, 0
            return out

        for frame in frames:
            for key, text in zip(frame["doc_id"], frame["text"], strict=True):
                keys.append(None if pd.isna(key) else key)
                texts.append(b"" if pd.isna(text) else text.encode())
                size += 16 + len(texts[-1])
                if size >= block_bytes:
                    yield row()
        if keys:
            yield row()

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "block long, doc_ids array<string>, texts binary")


def scored(documents: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = documents.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    named = blocks_of(documents, block_bytes)

    def build(frame: pd.DataFrame) -> tuple[Block, np.ndarray]:
        row = frame.iloc[0]
        held = np.array([held_out(key) for key in row["doc_ids"]], bool)
        return Block(zstandard.decompress(row["texts"]).split(BREAK), ~held, order), held

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        block, _ = build(frame)
        own, least = int(frame["block"].iloc[0]), borders(parts)
        # Every range hears of every block, and answers with its share of the tokens and words.
        rows = [(part, own, -1, b"", b"") for part in range(parts)]
        for k, (hashes, counts) in enumerate(zip(block.unique, block.count, strict=True)):
            cut = ranges(hashes, parts)
            for part in np.flatnonzero(np.diff(cut)).tolist():
                here = slice(cut[part], cut[part + 1])
                rows.append((part, own, k, planes(np.diff(hashes[here], prepend=least[part])), planes(counts[here])))
        return pd.DataFrame(rows, columns=["part", "block", "order", "hashes", "counts"])

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        rows, tokens, words, part = [], 0, 0, int(frame["part"].iloc[0])
        least = borders(parts)[part]
        for k, own in frame[frame["order"] >= 0].groupby("order"):
            hashes = [np.cumsum(numbers(b), dtype=np.uint64) + least for b in own["hashes"]]
            sizes, hashes = list(map(len, hashes)), np.concatenate(hashes)
            counts = np.concatenate([numbers(b) for b in own["counts"]]).astype(np.int64)
            unique, at = np.unique(hashes, return_inverse=True)
            totals = np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)
            if k == 0:
                tokens, words = int(totals.sum()), int((totals > 0).sum())
            totals = totals[at]
            start = 0
            for block, sent in zip(own["block"], sizes, strict=True):
                here = slice(start, start := start + sent)
                more = totals[here] != counts[here]
                if more.any():
                    rows.append((part, block, k, np.packbits(more).tobytes(), planes(totals[here][more])))
        share = planes(np.array([tokens, words]))
        rows += [(part, block, -1, b"", share) for block in frame.loc[frame["order"] < 0, "block"]]
        return pd.DataFrame(rows, columns=["part", "block", "order", "differs", "counts"])

    def score(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({name.split()[0]: [] for name in SCORES.split(", ")})
        block, held = build(own)
        counts = [c.copy() for c in block.count]
        tokens = words = 0
        cuts = [ranges(hashes, parts) for hashes in block.unique]
        for part, k, differs, totals in zip(sent["part"], sent["order"], sent["differs"], sent["counts"], strict=True):
            if k < 0:
                share = numbers(totals)
                tokens, words = tokens + int(share[0]), words + int(share[1])
            else:
                own_part = counts[k][cuts[k][part] : cuts[k][part + 1]]
                own_part[np.unpackbits(np.frombuffer(differs, np.uint8), count=len(own_part)).astype(bool)] = numbers(totals)
        base, weight = Automaton(block, counts, tokens, words).read()
        known = counts[0][block.at[0]] > 0
        return pd.DataFrame(
            {
                "doc_id": own["doc_ids"].iloc[0],
                "held_out": held,
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat(known.astype(np.int64), block.first),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, block.first),
                "score": np.add.reduceat(weight, block.first),
            }
        )

    sent = named.groupBy("block").applyInPandas(count, "part int, block long, order int, hashes binary, counts binary")
    totals = sent.groupBy("part").applyInPandas(add_up, "part int, block long, order int, differs binary, counts binary")
    found = named.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, SCORES)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
