"""Byte-level BPE: batched numpy merge rounds over many words in one flat symbol array.

Texts are cut at white space into chunks, chunks into words by the vocabulary's word rule. The words of a batch that were
not met before lie side by side in one array of symbols. Each round finds the lowest-ranked pair of every word (pair
keys are looked up by binary search among the sorted merge keys, only where a symbol has changed), merges all its
occurrences, and retires the words without a mergeable pair. The vocabulary file travels with the job; tasks keep a
bounded table of chunks already encoded.

Nulls: a null text is an empty text: no ids, empty decoded text. A null id keeps its row. Repeated rows stay. Extra
columns are ignored. Texts of any length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunks that a task remembers; the table starts anew when it is full.
MEMORY = 200_000
# Characters encoded together.
BATCH_CHARS = 4_000_000
NO_RANK = np.int32(2**31 - 1)
# The white space of the word rule (Unicode's White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def ranges_of(kind: str) -> str:
    """A regular-expression class body of all characters whose category starts with `kind`."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    body, first = [], codes[0]
    for code, after in zip(codes, codes[1:] + [-1], strict=True):
        if after != code + 1:
            body.append(f"\\U{first:08x}-\\U{code:08x}")
            first = after
    return "".join(body)


def word_pattern() -> re.Pattern[str]:
    """Contractions, letters, numbers and other signs, each with one space before it; white space."""
    letters, numbers = ranges_of("L"), ranges_of("N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


# Words never reach over the border of a chunk.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_names() -> dict[str, int]:
    """The character by which vocabulary files write each byte: itself if printable, else the next free above 255."""
    names, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            names[chr(byte)] = byte
        else:
            names[chr(free)] = byte
            free += 1
    return names


class Vocabulary:
    """Merges as sorted keys, the bytes of every id, and the strings that are ids of their own."""

    def __init__(self, content: str):
        spec = json.loads(content)
        ids, names = spec["model"]["vocab"], byte_names()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.arange(len(merges), dtype=np.int32)[order]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)  # by rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(names[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.symbol = np.zeros(256, np.int32)
        for character, byte in names.items():
            self.symbol[byte] = ids[character]
        self.names = [str(i) for i in range(size)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)


def merge_rounds(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in one array, number of ids per word)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocabulary.symbol[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    out_symbols, out_owner = [], []
    rank = np.full(len(symbols), NO_RANK)
    stale = np.arange(len(symbols))
    while len(symbols):
        rank[stale] = NO_RANK
        stale = stale[stale + 1 < len(symbols)]
        stale = stale[owner[stale] == owner[stale + 1]]
        rank[stale] = vocabulary.ranks(symbols[stale], symbols[stale + 1])
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = np.minimum.reduceat(rank, first)
        counts = np.diff(np.concatenate((first, [len(symbols)])))
        lowest = np.repeat(lowest, counts)
        done = lowest == NO_RANK
        if done.any():
            out_symbols.append(symbols[done])
            out_owner.append(owner[done])
            live = ~done
            symbols, owner, rank, lowest = symbols[live], owner[live], rank[live], lowest[live]
        hit = np.flatnonzero(rank == lowest)
        if not len(hit):
            continue
        # Of a run of overlapping occurrences (a a a) every second one is merged, from the left.
        runs = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
        start = np.flatnonzero(runs)
        hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.concatenate((start, [len(hit)]))))) % 2 == 0]
        symbols[hit] = vocabulary.merged[rank[hit]]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        place = np.cumsum(stay) - 1
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        hit = place[hit]
        stale = np.unique(np.concatenate((hit, np.maximum(hit - 1, 0))))
    symbols = np.concatenate(out_symbols) if out_symbols else symbols
    owner = np.concatenate(out_owner) if out_owner else owner
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes texts; remembers the ids of chunks."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.vocabulary, self.memory = vocabulary, memory
        self.pattern = word_pattern()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.vocabulary.special):
            return CHUNKS.findall(text)
        found = []
        for i, part in enumerate(self.split.split(text)):
            found += [("special", part)] if i % 2 else CHUNKS.findall(part)
        return found

    def learn(self, fresh: list) -> None:
        """Encodes chunks not met before and appends them to the table."""
        words, owner, special = [], [], []
        for i, chunk in enumerate(fresh):
            if isinstance(chunk, tuple):
                special.append((i, self.vocabulary.special[chunk[1]]))
                continue
            found = self.pattern.findall(chunk)
            words += found
            owner += [i] * len(found)
        ids, counts = merge_rounds([w.encode() for w in words], self.vocabulary)
        owner = np.repeat(np.array(owner, np.int64), counts)
        if special:
            at = np.array([i for i, _ in special])
            ids = np.concatenate((ids, np.array([t for _, t in special], np.int32)))
            owner = np.concatenate((owner, at))
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        sizes = np.bincount(owner, minlength=len(fresh))
        base = len(self.index)
        self.index.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.memory:
            self.forget()
        cut = [self.chunks(text) for text in texts]
        fresh = {chunk for chunks in cut for chunk in chunks if chunk not in self.index}
        if fresh:
            self.learn(list(fresh))
        out = []
        for chunks in cut:
            at = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
            first, size = self.start[at], self.start[at + 1] - self.start[at]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(at) else 0)])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def in_batches(frames: Iterator[pd.DataFrame], column: str, chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The frames cut into runs of rows of about `chars` characters; a longer text is a run of its own."""
    for frame in frames:
        frame = frame.assign(**{column: frame[column].fillna("")})
        size = frame[column].str.len().to_numpy(np.int64)
        run = np.cumsum(size) // chars if len(frame) else size
        for _, part in frame.groupby(run, sort=True):
            yield part


def vocabulary_file(path: str | None = None) -> str:
    """The content of a vocabulary file; by default the public byte-level one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the ids of every whole text and the text decoded from them."""
    content = documents.sparkSession.sparkContext.broadcast(vocabulary_file(path))  # one vocabulary file, 1.6 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(content.value))
        for part in in_batches(frames, "text"):
            ids = [found.tolist() for found in encoder.encode(part["text"].tolist())]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "text": [encoder.decode(i) for i in ids]})

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "doc_id string, ids array<int>, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as `encoded`, with digests taken in the task."""
    content = documents.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(content.value))
        names = encoder.vocabulary.names
        for part in in_batches(frames, "text"):
            rows = []
            for found in encoder.encode(part["text"].tolist()):
                ids = found.tolist()
                listed = ",".join(map(names.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = named.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids: what training reads."""
    return encoded(documents, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
