"""Phrase collocations from weighted acyclic automata.

Texts (A-Z lower-cased) are cut at sentence signs into pieces and these at blanks into words. Each language has its own counts.

1. Tasks turn their texts into shards: token numbers and the distinct words with their counts. The words' counts are summed;
   words of at least `least` occurrences get an id. A phrase counts `least` only if all its words do,
   so other words end every phrase.
2. Each shard lists its pairs of neighbouring words, sorted, equal ones counted once. From these sorted n-grams it builds a count
   transducer: states are their prefixes, made row by row where a row departs from the one before it; an arc per next word; a
   weight where n-grams end. Its sorted n-grams are cut at the borders of prefix ranges, one transducer a range.
3. A range's transducers are united layer by layer: arcs with equal origin and word become one, weights are added up. Each
   shard hears, a bit per pair, which of its pairs are frequent. Then it lists the up to `longest` words that begin at each
   place and go on as long as pairs are frequent, and these go the same way. The weight that passes through a state is the count of
   its phrase in the range. A phrase whose n-grams lie across a border is on the range's first or last path, so those
   are handed on whatever their count, and sums over ranges are exact.
4. The states left, of all ranges, are the transducer of the frequent phrases, each named by its path. The parts of every cut of a
   candidate are composed with it: the state that a part leads to has the part's name, so the lookup is a join.

Borders are quantiles of a bounded sample of n-grams (RANGE_SAMPLE a range, SAMPLE in all), drawn from every shard by its length; any
borders give the same result. Nothing is sent to all tasks but the borders and, if Spark finds them few, the languages' totals.

Nulls: a null text is empty, a null lang is `und`; ids are not read. Repeated rows count each. Extra columns are ignored. Texts
count whole; longer ones than SHARD_BYTES become several shards, cut between pieces. No candidate, or no rows: an empty result.
Products are taken in 38-digit decimals. Equal scores are in order of count, then of the phrase's bytes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import arrow_rows, saved

LEAST = 100
LONGEST = 5
TOP = 2000
# Bytes of text that a shard holds, and n-grams that a prefix range aims at.
SHARD_BYTES = 4 << 20
RANGE_GRAMS = 1_000_000
# Bits of a word's id that name its partition.
PART_BITS = 20
# Documents, and shards, that are handed to a task's Python at a time.
TEXT_ROWS = 1000
SHARD_ROWS = 4
# N-grams that the borders are taken from, for each range and in all.
RANGE_SAMPLE = 256
SAMPLE = 1_000_000

END = b"\xff"  # no byte of any text: the end of a piece
BYTES = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, which never passes one through the driver.

    Left alone, Spark broadcasts what it takes to be small by the size of compressed files; as rows it may be many times that.
    """
    return left.join(right.hint("merge"), on, how)


def planes(values: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first bytes first, without the last planes if all zero, compressed; the first byte counts the planes."""
    values = np.ascontiguousarray(values, np.uint64)
    used = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return zstandard.compress(bytes([used]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes(), 1)


def numbers(packed: bytes) -> np.ndarray:
    packed = zstandard.decompress(packed)
    used = packed[0]
    own = np.frombuffer(packed, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, :used] = own.T
    return out.view(np.int64).ravel()


class Words:
    """The token numbers of the texts of a shard; 0 ends a piece."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {END: 0}
        known = number.setdefault
        parts = []
        for text in texts:
            words = text.replace(END, b" \xff ").split()
            parts.append(np.fromiter((known(w, len(number)) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        tokens = np.concatenate(parts)
        counts = np.bincount(tokens, minlength=len(number))
        order = np.argsort(-counts[1:], kind="stable")
        place = np.zeros(len(number), np.int64)
        place[order + 1] = np.arange(1, len(number))
        words = list(number)
        self.words = [words[i + 1].decode() for i in order.tolist()]
        self.counts, self.tokens = counts[order + 1], place[tokens]


def cut_texts(text: str | None, size: int) -> Iterator[bytes]:
    """The bytes of a text, ready for splitting, in parts of `size` or a little more that end with a piece."""
    data = (text or "").encode().translate(BYTES)
    start = 0
    while len(data) - start > size and (end := data.find(END, start + size)) >= 0:
        yield data[start:end]
        start = end + 1
    yield data[start:] if start else data


def shards(documents: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, n (words), words, counts, tokens: about `size` bytes of one language's texts in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def row(lang: str) -> pd.DataFrame:
            nonlocal made
            made += 1
            own = Words(held.pop(lang))
            del sizes[lang]
            return pd.DataFrame([(f"{task}-{made}", lang, int(own.counts.sum()), own.words, own.counts, planes(own.tokens))], columns=["shard", "lang", "n", "words", "counts", "tokens"])

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                for data in cut_texts(text, size):
                    held.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data) + 64
                    if sizes[lang] >= size:
                        yield row(lang)
            while sum(sizes.values()) > 2 * size:
                yield row(max(sizes, key=sizes.get))
        for lang in list(held):
            yield row(lang)

    named = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return named.mapInPandas(run, "shard string, lang string, n long, words array<string>, counts array<long>, tokens binary")


def frequent_words(pieces: DataFrame, least: int) -> DataFrame:
    """shard, place, id: the ids of a shard's words with at least `least` occurrences in all; and, on the first row of each word, lang, word, f.

    Words meet once, one row a shard, to be counted and numbered. A word's id is made of its place in its partition and the partition.
    """
    each = pieces.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    each = each.select("shard", "place", "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    found = each.withColumn("f", F.sum("count").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= least)

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for frame in frames:
            lang, word = frame["lang"].to_numpy(), frame["word"].to_numpy()
            first = np.ones(len(frame), bool)
            first[1:] = (lang[1:] != lang[:-1]) | (word[1:] != word[:-1])
            if len(frame):
                first[0] = (lang[0], word[0]) != last
                last = lang[-1], word[-1]
            rank = count + np.cumsum(first)
            count += int(first.sum())
            shown = {"lang": np.where(first, lang, None), "word": np.where(first, word, None), "f": frame["f"].astype("Int64").where(pd.Series(first, frame.index))}
            yield frame[["shard", "place"]].assign(id=rank << PART_BITS | part, **shown)

    # The window leaves the rows of a partition sorted by language and word.
    return found.drop("count").mapInPandas(number, "shard string, place int, id long, lang string, word string, f long")


def sorted_grams(ids: np.ndarray, links: np.ndarray, fewest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct n-grams, sorted; their counts; the places where one begins; which of the distinct ones it is).

    `links` tells of each place whether its word goes on to the next. An n-gram ends after `longest` words or
    where there is no link (0 follows); those of less than `fewest` words are left out.
    """
    known, rank = np.unique(ids, return_inverse=True)
    if not len(known) or known[0] != 0:
        known, rank = np.concatenate(([0], known)), rank + 1
    padded = np.concatenate((rank, np.zeros(longest, rank.dtype)))
    links = np.concatenate((links, np.zeros(longest, bool)))
    start = np.arange(len(ids))
    for j in range(fewest - 1):
        start = start[links[start + j]]
    columns, alive = [padded[start]], np.ones(len(start), bool)
    for j in range(1, longest):
        alive = alive & links[start + j - 1]
        columns.append(np.where(alive, padded[start + j], 0))
    # Columns side by side in as few words as hold them, to sort by.
    bits = max(1, int(len(known) - 1).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for j in range(0, longest, each):
        key = np.zeros(len(start), np.int64)
        for column in columns[j : j + each]:
            key = key << bits | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    grams = np.stack([known[column[order[first]]] for column in columns], axis=1).astype(np.int64)
    return grams, np.diff(np.append(first, len(order))), start, which


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`sorted_grams` of the pairs of neighbouring words that have ids."""
    links = np.zeros(len(ids), bool)
    links[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
    return sorted_grams(ids, links, 2, 2)


def grams_of(ids: np.ndarray, mask: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of three words or more whose pairs are all frequent by `mask`, a bit per distinct pair; their counts."""
    _, _, start, which = pairs_of(ids)
    links = np.zeros(len(ids), bool)
    links[start] = mask[which]
    return sorted_grams(ids, links, 3, longest)[:2]


class Transducer:
    """Count transducer in layers: per layer the origin (a state of the layer above) and the word of each arc, sorted, and the weight of n-grams that end with it."""

    def __init__(self, origins: list[np.ndarray], words: list[np.ndarray], weights: list[np.ndarray]):
        self.origins, self.words, self.weights = origins, words, weights

    @classmethod
    def build(cls, grams: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted distinct n-grams: a row makes new states from the first word on in which it departs from the row before."""
        departs = np.ones(len(grams), bool)
        if len(grams):
            departs[1:] = False
        state = np.zeros(len(grams), np.int64)
        origins, words, weights = [], [], []
        width = grams.shape[1]
        for layer in range(width):
            word = grams[:, layer]
            departs[1:] |= word[1:] != word[:-1]
            new = departs & (word > 0)
            origins.append(state[new])
            words.append(word[new])
            state = np.cumsum(new) - 1
            last = word > 0
            if layer + 1 < width:
                last = last & (grams[:, layer + 1] == 0)
            weights.append(np.bincount(state[last], weights=counts[last], minlength=len(words[-1])).astype(np.int64))
        return cls(origins, words, weights)

    @classmethod
    def united(cls, several: list[Transducer]) -> tuple[Transducer, list[np.ndarray]]:
        """(the union, the state of it that each state of the last layer of each part became).

        Layer by layer, arcs with equal origin and word are one, and their weights are added.
        """
        places = [np.zeros(1, np.int64) for _ in several]
        origins, words, weights = [], [], []
        for layer in range(max(len(t.words) for t in several)):
            origin = np.concatenate([place[t.origins[layer]] for t, place in zip(several, places, strict=True)])
            word = np.concatenate([t.words[layer] for t in several])
            weight = np.concatenate([t.weights[layer] for t in several])
            order = np.lexsort((word, origin))
            origin, word = origin[order], word[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (origin[1:] != origin[:-1]) | (word[1:] != word[:-1])
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(fresh) - 1
            origins.append(origin[fresh])
            words.append(word[fresh])
            weights.append(np.bincount(at, weights=weight, minlength=len(words[-1])).astype(np.int64))
            places = np.split(at, np.cumsum([len(t.words[layer]) for t in several])[:-1])
        return cls(origins, words, weights), places

    def counts(self) -> list[np.ndarray]:
        """Per layer, the weight that ends in or passes through each state: the count of its phrase."""
        found = [self.weights[-1]]
        for layer in range(len(self.words) - 1, 0, -1):
            below = np.bincount(self.origins[layer], weights=found[0], minlength=len(self.words[layer - 1]))
            found.insert(0, self.weights[layer - 1] + below.astype(np.int64))
        return found

    def phrases(self, layer: int, states: np.ndarray) -> np.ndarray:
        """The words on the paths to states of a layer, a row each."""
        columns = []
        while layer >= 0:
            columns.append(self.words[layer][states])
            states, layer = self.origins[layer][states], layer - 1
        return np.stack(columns[::-1], axis=1)

    def packed(self) -> list[bytes]:
        """Three compressed byte strings a layer: arcs per origin, words, weights."""
        out, above = [], 1
        for origin, word, weight in zip(self.origins, self.words, self.weights, strict=True):
            out += [planes(np.bincount(origin, minlength=above)), planes(word), planes(weight)]
            above = len(word)
        return out

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Transducer:
        arcs, words, weights = ([numbers(part) for part in parts[i::3]] for i in range(3))
        return cls([np.repeat(np.arange(len(a)), a) for a in arcs], words, weights)


def _before(grams: np.ndarray, border: tuple[int, ...]) -> int:
    """How many of the sorted n-grams are less than the border."""
    return bisect_left(range(len(grams)), border, key=lambda i: tuple(grams[i].tolist()))


def coded_shards(pieces: DataFrame, numbered: DataFrame) -> DataFrame:
    """shard, ids: the word ids of a shard's tokens in order, 0 for ends and words that are not frequent."""
    known = numbered.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    met = merged(pieces.select("shard", "tokens"), known, "shard").select("shard", "tokens", F.col("known.place").alias("places"), F.col("known.id").alias("ids"))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            coded = []
            for tokens, places, known in zip(frame["tokens"], frame["places"], frame["ids"], strict=True):
                tokens = numbers(tokens)
                ids = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
                ids[places + 1] = known
                coded.append(planes(ids[tokens]))
            yield pd.DataFrame({"shard": frame["shard"], "ids": coded})

    return met.mapInPandas(code, "shard string, ids binary")


def sampled_grams(ids: np.ndarray, count: int, fewest: int, longest: int, seed: int) -> np.ndarray:
    """The n-grams, as if all pairs were frequent, at `count` places drawn by chance; those of less than `fewest` words are left out."""
    padded = np.concatenate((ids, np.zeros(longest, np.int64)))
    places = np.random.default_rng(seed).integers(0, max(1, len(ids)), count)
    grams = np.stack([padded[places + j] for j in range(longest)], axis=1)
    grams *= np.logical_and.accumulate(grams > 0, axis=1)
    return grams[grams[:, fewest - 1] > 0]


def borders_of(shards: DataFrame, fewest: int, longest: int, size: int, range_grams: int) -> list[tuple[int, ...]]:
    """N-grams that cut the sorted n-grams of all shards into ranges of at most about `range_grams`.

    Every shard is drawn from, by its length, so that no language or part of the table is left to one range. A range's n-grams
    are no more than its places, also where infrequent pairs cut them short.
    """
    ranges = max(1, -(-size // range_grams))
    if ranges == 1:
        return []
    share = min(1.0, min(SAMPLE, ranges * RANGE_SAMPLE) / size)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, ids in zip(frame["shard"], frame["ids"], strict=True):
                ids, seed = numbers(ids), zlib.crc32(shard.encode())
                grams = sampled_grams(ids, int(len(ids) * share + seed / (1 << 32)), fewest, longest, seed)
                yield pd.DataFrame({"grams": [grams.tobytes()]})

    rows = shards.select("shard", "ids").mapInPandas(sample, "grams binary").collect()  # SAMPLE n-grams at most, give or take one a shard
    drawn = np.frombuffer(b"".join(row.grams for row in rows), np.int64).reshape(-1, longest)
    drawn = drawn[np.lexsort(drawn.T[::-1])]
    return sorted({tuple(drawn[i * len(drawn) // ranges].tolist()) for i in range(1, ranges)}) if len(drawn) else []


def _parts(grams: np.ndarray, counts: np.ndarray, borders: list[tuple[int, ...]]) -> Iterator[tuple[int, list[bytes]]]:
    """(range, packed transducer) of each range that has some of the sorted n-grams."""
    ends = np.array([0, *(_before(grams, border) for border in borders), len(grams)])
    for part in np.flatnonzero(np.diff(ends)).tolist():
        here = slice(ends[part], ends[part + 1])
        yield part, Transducer.build(grams[here], counts[here]).packed()


def frequent_pairs(coded: DataFrame, size: int, least: int, range_grams: int) -> DataFrame:
    """Rows ids, f of the frequent pairs, and rows shard, range, mask, pairs: which of a shard's sorted pairs in a range are frequent."""

    sent = coded.sparkSession.sparkContext.broadcast(borders_of(coded, 2, 2, size, range_grams))  # one pair a range

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, ids in zip(frame["shard"], frame["ids"], strict=True):
                grams, counts, _, _ = pairs_of(numbers(ids))
                yield pd.DataFrame([(shard, *part) for part in _parts(grams, counts, sent.value)], columns=["shard", "range", "layers"])

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        # Equal pairs lie in one range, so their sums are whole here.
        several = [Transducer.unpacked(list(layers)) for layers in frame["layers"]]
        whole, places = Transducer.united(several)
        counts = whole.counts()[1]
        rows = [(shard, part, np.packbits(counts[at] >= least).tobytes(), len(at), None, None) for shard, part, at in zip(frame["shard"], frame["range"], places, strict=True)]
        states = np.flatnonzero(counts >= least)
        rows += [(None, None, None, None, ids, f) for ids, f in zip(whole.phrases(1, states).tolist(), counts[states].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["shard", "range", "mask", "pairs", "ids", "f"]).astype({"range": "Int32", "pairs": "Int64", "f": "Int64"})

    parts = coded.mapInPandas(cut, "shard string, range int, layers array<binary>")
    return parts.groupBy("range").applyInPandas(unite, "shard string, range int, mask binary, pairs long, ids array<long>, f long")


def longer_phrases(coded: DataFrame, masks: DataFrame, size: int, least: int, longest: int, range_grams: int) -> DataFrame:
    """ids, f of the frequent phrases of three words or more."""
    spark = coded.sparkSession
    listed = masks.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("range", "mask", "pairs"))).alias("masks"))
    met = merged(coded, listed, "shard").select("shard", "ids", F.col("masks.mask").alias("masks"), F.col("masks.pairs").alias("pairs"))

    def grams(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, masks, pairs in zip(frame["ids"], frame["masks"], frame["pairs"], strict=True):
            mask = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks, pairs, strict=True)]).astype(bool)
            yield grams_of(numbers(ids), mask, longest)

    sent = spark.sparkContext.broadcast(borders_of(coded, 3, longest, size, range_grams))  # one n-gram a range

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for found, counts in grams(frame):
                yield pd.DataFrame(_parts(found, counts, sent.value), columns=["range", "layers"])

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        whole, _ = Transducer.united([Transducer.unpacked(list(layers)) for layers in frame["layers"]])
        ids, f = [], []
        for layer, counts in enumerate(whole.counts()):
            if layer > 1 and len(counts):
                keep = counts >= least
                keep[[0, -1]] = True  # paths that n-grams of a neighbouring range may share
                states = np.flatnonzero(keep)
                ids += list(whole.phrases(layer, states))
                f.append(counts[states])
        return pd.DataFrame({"ids": ids, "f": np.concatenate(f)})

    found = met.mapInPandas(cut, "range int, layers array<binary>").groupBy("range").applyInPandas(unite, "ids array<long>, f long")
    return found.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(pieces: DataFrame, numbered: DataFrame, least: int, longest: int, range_grams: int) -> DataFrame:
    """ids, f of all phrases of 2 to `longest` words with at least `least` occurrences."""
    spark = pieces.sparkSession
    size = pieces.agg(F.sum("n")).first()[0] or 0
    with arrow_rows(spark, SHARD_ROWS):
        coded = saved(coded_shards(pieces, numbered), "coded-shards", 8 << 20)
        pairs = saved(frequent_pairs(coded, size, least, range_grams), "pairs")
        found = pairs.where("ids is not null").select("ids", "f")
        if longest < 3:
            return found
        masks = pairs.where("ids is null").select("shard", "range", "mask", "pairs")
        return found.union(saved(longer_phrases(coded, masks, size, least, longest, range_grams), "longer-phrases"))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100, shard_bytes: int = SHARD_BYTES, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    A phrase that lies in a longer candidate with at least `share` per cent of its count is left out.
    """
    spark = documents.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        pieces = saved(shards(documents, shard_bytes), "shards", 8 << 20)
    numbered = saved(frequent_words(pieces, least), "frequent-words")
    words = numbered.where("word is not null").select("id", "lang", "word", "f")
    phrases = frequent_phrases(pieces, numbered, least, longest, range_grams)

    # Parts of candidates are as frequent as candidates, so all are states of this transducer.
    states = phrases.union(words.select(F.array("id").alias("ids"), "f"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("ids") - size + 1), lambda at: F.slice("ids", at, size))))
    longer = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), F.col("f").alias("around")).groupBy("ids").agg(F.max("around").alias("around"))
    left = merged(phrases, longer, "ids", "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("f"))).select("ids", F.col("f").alias("a"))

    totals = pieces.groupBy("lang").agg(F.sum("n").alias("n"))
    language = words.select(F.col("id").alias("first_id"), "lang")
    left = merged(left.withColumn("first_id", F.col("ids")[0]), language, "first_id").join(totals, "lang")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.size("ids")))
    cuts = merged(cuts, states.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = merged(cuts, states.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(18,0)) * cast(n as decimal(18,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.withColumn("score", score).groupBy("ids").agg(F.min_by(F.struct("lang", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    lowest = saved(lowest.select("ids", "best.*"), "scored")

    spelled = merged(lowest.select("ids", F.posexplode("ids").alias("at", "id")), words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda entry: entry["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = merged(lowest, spelled, "ids").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces),
totals as (select lang, sum(len(words))::bigint as n from split group by lang),
places as (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from split, range(1, 6) as sizes(k)),
counts as (
    select lang, words[i : i + k - 1] as phrase, count(*) as f from places group by all having count(*) >= 100
),
candidates as (select lang, phrase, f as a from counts where len(phrase) >= 2),
inside as (
    select c.lang, c.phrase[i : i + k - 1] as phrase, max(c.a) as around
    from candidates c, range(2, 5) as sizes(k), range(1, 5) as starts(i)
    where k < len(c.phrase) and i + k - 1 <= len(c.phrase) group by all
),
kept as (
    select c.* from candidates c left join inside i on c.lang = i.lang and c.phrase = i.phrase
    where around is null or 100 * around < 100 * a
),
cuts as (
    select t.lang, t.phrase, k, a, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score
    from kept t join totals on t.lang = totals.lang cross join range(1, 5) as parts(k)
    join counts l on l.lang = t.lang and l.phrase = t.phrase[1:k]
    join counts r on r.lang = t.lang and r.phrase = t.phrase[k + 1:]
    where k < len(t.phrase)
),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from cuts),
ranked as (
    select * exclude (phrase), array_to_string(phrase, ' ') as phrase,
        row_number() over (partition by lang order by score desc, a desc, array_to_string(phrase, ' ')) as rank
    from lowest where nth = 1
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
