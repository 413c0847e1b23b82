"""Byte-level BPE by rank: a queue of merge ranks under a hierarchical bitmap, for words of any length.

Texts are cut at white space into chunks and chunks into words by the vocabulary's word rule. A word that is a token is
one id. Any other word is a linked list of tokens, at first its bytes. Every pair of neighbours whose joined bytes are a
token waits at its left position in the bucket of that token's rank. A bitmap in two levels has one bit per bucket that is
not empty, in groups, and above them one bit per group that is not zero: finding the lowest rank takes one find-first-set
per level, whatever the word's length. The lowest rank's leftmost entry is taken; entries whose pair has changed meanwhile
are stale and skipped. A merge unlinks the right neighbour and queues the two pairs around it, so a word of n bytes makes
at most 3n entries.

Nulls: a null text is an empty text: no ids, empty decoded bytes. A null id keeps its row. Repeated rows stay. Extra columns
are ignored. Texts of any length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import CHUNKS, in_batches, word_pattern

# Chunks, and words, that a task remembers (in two halves by age; the older one goes when the younger is full), and the longest remembered.
MEMORY = 400_000
LONGEST = 200


class Ranks:
    """Tokens by rank, and for every pair of tokens that together are a token, where that token waits."""

    def __init__(self, content: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        size = max(self.ids.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in self.ids.items():
            self.bytes[rank] = token
        self.names = [str(rank) for rank in range(size)]
        self.first = [self.ids[bytes([byte])] for byte in range(256)]
        # The queue, empty between words: buckets of positions, and the groups of the bitmap. Bits count down, so
        # that the lowest rank is the highest bit.
        self.last, self.shift = size - 1, (size.bit_length() + 1) // 2
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.groups = [0] * ((self.last >> self.shift) + 1)
        self.bit = [1 << i for i in range(max(len(self.groups), 1 << self.shift))]
        # left -> right -> (the joined token, its bucket, its group, its bit there, its group's bit)
        self.pairs: list[dict[int, tuple[int, list[int], int, int, int]]] = [{} for _ in range(size)]
        for token, rank in self.ids.items():
            group, low = divmod(self.last - rank, 1 << self.shift)
            home = rank, self.buckets[rank], group, self.bit[low], self.bit[group]
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left][right] = home

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        pairs, buckets, groups, bit, shift, last = self.pairs, self.buckets, self.groups, self.bit, self.shift, self.last
        token = list(map(self.first.__getitem__, word))
        size = len(token)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        waits = [-1] * size  # the rank of the pair that begins here
        top = 0

        for at in range(size - 1):
            home = pairs[token[at]].get(token[at + 1])
            if home is not None:
                waits[at], bucket, group, own, above = home
                bucket.append(at)  # ascending positions are a heap
                groups[group] |= own
                top |= above
        while top:
            group = top.bit_length() - 1
            low = groups[group].bit_length() - 1
            rank = last - (group << shift | low)
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                groups[group] ^= bit[low]
                if not groups[group]:
                    top ^= bit[group]
            # Stale: the token here was merged into its left neighbour, or one of the two has grown.
            if waits[at] != rank:
                continue
            right, ahead = after[at], before[at]
            behind = after[right]
            token[at], token[right] = rank, -1
            waits[at] = waits[right] = -1
            after[at] = behind
            if behind < size:
                before[behind] = at
                home = pairs[rank].get(token[behind])
                if home is not None:
                    waits[at], bucket, group, own, above = home
                    heappush(bucket, at)
                    groups[group] |= own
                    top |= above
            if ahead >= 0:
                home = pairs[token[ahead]].get(rank)
                if home is None:
                    waits[ahead] = -1
                else:
                    waits[ahead], bucket, group, own, above = home
                    heappush(bucket, ahead)
                    groups[group] |= own
                    top |= above
        return [t for t in token if t >= 0]


class Remembered(dict):
    """The values of up to `most` keys, by age: when the younger half is full, what was not asked for since it began is dropped."""

    def __init__(self, most: int):
        self.half, self.older = max(1, most // 2), {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """Encodes texts; remembers the ids of chunks and of words."""

    def __init__(self, content: bytes, memory: int = MEMORY):
        self.ranks = Ranks(content)
        self.chunks, self.words = Remembered(memory), Remembered(memory)
        self.pattern = word_pattern()

    def word(self, word: str) -> list[int]:
        ids = self.words[word]
        if ids is None:
            ids = self.ranks.encode(word.encode())
            if len(word) <= LONGEST:
                self.words.keep(word, ids)
        return ids

    def chunk(self, chunk: str) -> list[int]:
        words = self.pattern.findall(chunk)
        ids = self.word(words[0]) if len(words) == 1 else list(chain.from_iterable(map(self.word, words)))
        if len(chunk) <= LONGEST:
            self.chunks.keep(chunk, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        known, ids = self.chunks, []
        for chunk in CHUNKS.findall(text):
            found = known[chunk]
            ids += self.chunk(chunk) if found is None else found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder_of(content: bytes) -> Encoder:
    """One encoder per Python worker: its tasks share the remembered chunks."""
    return Encoder(content)


def ranks_file(path: str | None = None) -> bytes:
    """The content of a file of ranks; by default the public byte-level one of 50,256 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return file.read()


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text and the bytes decoded from them."""
    return _mapped(documents, path, "ids array<int>, decoded binary", lambda encoder, ids: (ids, encoder.decode(ids)))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as `encoded`, with digests taken in the task."""

    def row(encoder: Encoder, ids: list[int]) -> tuple[int, str, str]:
        listed = " ".join(map(encoder.ranks.names.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    return _mapped(documents, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _mapped(documents: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    content = documents.sparkSession.sparkContext.broadcast(ranks_file(path))  # one file of ranks, 0.8 MB
    names = [column.split()[0] for column in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(content.value)
        for part in in_batches(frames, "text"):
            out = pd.DataFrame([row(encoder, encoder.encode(text)) for text in part["text"]], columns=names)
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    # Ids pass as text: a null among them would turn whole numbers into floating ones.
    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))
