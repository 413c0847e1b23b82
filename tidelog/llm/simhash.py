"""Near duplicates by SimHash: bit planes stored vertically, distances counted with carry-save adders.

Fingerprints within `radius` bits of each other are linked; classes are the transitive closure. Candidates come from
block combinations: with k blocks and radius r, at least k - r blocks of two linked fingerprints are equal, so each
fingerprint enters C(k, r) buckets. k grows with the number of distinct fingerprints (every k gives the same links).
Buckets above TILE members are cut into tiles of which every two meet, so no task holds a whole bucket.

Inside a task the members of many buckets lie side by side in 64 bit planes. A shift by s compares every member with
the member s places on, 64 pairs per machine word: differing bits are added up in three counter planes and an overflow
plane. Words in which all pairs exceed the radius are abandoned after every few planes. Tasks emit a spanning forest of
their links, never all pairs.

Nulls: a null text is an empty text, whose fingerprint is zero and is linked like any other; a row with a null id keeps
its row and counts as having no id. Repeated ids and rows stay. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import connected_classes, rows_per_task, saved

RADIUS = 4
SHINGLE = 4
TILE = 1024
# Rows that a task lays out side by side at a time (a bucket is never cut here).
LAYOUT_ROWS = 400_000
BUCKET_ROWS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text: bit set where over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.dtype("<i8"))[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keys: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, the keys, fp) per document."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, shingle) for text in texts], dtype="int64")

    return documents.select("doc_id", *keys, of("text").alias("fp"))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed masks of the block combinations that two fingerprints within the radius share one of."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in whole]


def blocks_for(distinct: int, radius: int) -> int:
    """The fewest blocks whose buckets hold about BUCKET_ROWS of evenly spread fingerprints."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct / 2 ** (64 * (blocks - radius) / blocks) > BUCKET_ROWS:
        blocks += 1
    return blocks


class BitPlanes:
    """Fingerprints of many buckets side by side: plane b holds bit b of every member."""

    def __init__(self, prints: np.ndarray):
        self.size = len(prints)
        self.words = -(-self.size // 64) + 1
        padded = np.zeros(self.words * 64, np.uint64)
        padded[: self.size] = prints
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)

    def close(self, shift: int, live: np.ndarray, radius: int) -> np.ndarray:
        """Positions i of `live` (words as a mask) whose member i + shift differs in at most `radius` bits."""
        at = np.flatnonzero(live)
        alive = live[at]
        jump, bits = divmod(shift, 64)
        ones = np.zeros(len(at), np.uint64)
        twos, fours, over = ones.copy(), ones.copy(), ones.copy()
        low, high = np.uint64(bits), np.uint64(64 - bits)
        for b in range(64):
            plane = self.planes[b]
            other = plane[np.minimum(at + jump, self.words - 1)]
            if bits:
                other = (other >> low) | (plane[np.minimum(at + jump + 1, self.words - 1)] << high)
            carry = plane[at] ^ other
            ones, carry = ones ^ carry, ones & carry
            twos, carry = twos ^ carry, twos & carry
            fours, carry = fours ^ carry, fours & carry
            over |= carry
            if b % 8 == 7:
                alive &= ~_exceeds(ones, twos, fours, over, radius)
                keep = np.flatnonzero(alive)
                if not len(keep):
                    return keep
                if 2 * len(keep) < len(at):
                    at, alive = at[keep], alive[keep]
                    ones, twos, fours, over = ones[keep], twos[keep], fours[keep], over[keep]
        hits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(hits)
        return at[word] * 64 + bit


def _exceeds(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Where the counter (ones + 2 twos + 4 fours, or more if over) is above the radius, for radius 0 to 7."""
    above = np.zeros_like(ones)
    equal = ~np.zeros_like(ones)
    for plane, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above | over


def linked_in_groups(groups: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as pairs of positions) of the links between members of equal groups.

    `groups` is sorted in runs; `prints` are unsigned.
    """
    n = len(prints)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    ends = np.cumsum(sizes)
    place = np.repeat(starts - (ends - sizes), sizes) + np.arange(n)
    left = np.repeat(ends, sizes) - np.arange(n)  # members from here to the end of the bucket, itself included
    planes = BitPlanes(prints[place])
    parent = np.arange(n)
    for shift in range(1, int(sizes[0]) if n else 0):
        many = int(ends[np.searchsorted(-sizes, -shift) - 1])  # buckets above `shift` members come first
        live = np.packbits(left[:many] > shift, bitorder="little")
        live = np.concatenate((live, np.zeros(-len(live) % 8, np.uint8))).view(np.uint64)
        found = planes.close(shift, live, radius)
        if len(found):
            _unite(parent, found, found + shift)
    roots = _roots(parent, np.arange(n))
    child = np.flatnonzero(roots != np.arange(n))
    return place[child], place[roots[child]]


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    found = parent[nodes]
    while True:
        up = parent[found]
        if (up == found).all():
            return found
        found = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) pairs of distinct fingerprints `fp` whose transitive closure is that of all links within the radius."""
    distinct = saved(prints.select("fp").distinct(), "prints")
    blocks = blocks_for(distinct.count(), radius)
    masks = block_masks(blocks, radius)
    # The hash only names a bucket; a collision adds candidates, which are compared like any others.
    named = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks)]
    entries = distinct.select("fp", F.explode(F.array(*named)).alias("bucket"))
    crowded = entries.groupBy("bucket").count().where(F.col("count") > tile)
    crowded = crowded.select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), "tiles").cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64("bucket", F.least(t, mine), F.greatest(t, mine)))
    groups = F.when(F.col("tiles").isNull(), F.array("bucket")).otherwise(meets)
    parted = entries.join(crowded, "bucket", "left").select("fp", F.explode(groups).alias("bucket"))
    tasks = rows_per_task(distinct.count() * comb(blocks, radius), 300_000, 12)
    parted = parted.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            prints = part["fp"].to_numpy(np.int64)
            a, b = linked_in_groups(part["bucket"].to_numpy(np.int64), prints.view(np.uint64), radius)
            yield pd.DataFrame({"a": prints[a], "b": prints[b]}).drop_duplicates()

    return parted.mapInPandas(forest, "a long, b long")


def whole_groups(batches: Iterator[pd.DataFrame], rows: int = LAYOUT_ROWS) -> Iterator[pd.DataFrame]:
    """Batches sorted by `bucket`, regrouped so that no bucket is cut; buckets of one member are dropped."""
    held: list[pd.DataFrame] = []
    count = 0

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        names = part["bucket"].to_numpy()
        same = names[1:] == names[:-1]
        return part[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(part) else part

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            part = pd.concat(held, ignore_index=True)
            last = part["bucket"].to_numpy() == part["bucket"].iloc[-1]
            if not last.all():
                yield shared(part[~last])
            held, count = [part[last]], int(last.sum())
    if held:
        yield shared(pd.concat(held, ignore_index=True))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the smallest doc_id of the class (null if it has none)."""
    prints = saved(fingerprints(documents, shingle), "simhash")
    roots = connected_classes(links(prints, radius), "simhash-links")
    members = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    members = members.join(roots, F.col("fp") == F.col("node"), "left")
    members = members.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = members.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op5(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id."""
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class: that with the smallest doc_id, rows without one last; of rows with that id, the text with the
    smallest hash; of rows equal in id and text, any one.

    Every row has the class of its own text, so rows that share an id and not their text are judged apart.
    """
    keys = (F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit("text"), "doc_id", "text").alias("key2"))
    prints = saved(fingerprints(documents, shingle, keys), "simhash-rows")
    roots = connected_classes(links(prints.select("fp"), radius), "simhash-links")
    own = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    # The key of the first row is read from a minimum, which is taken before the shuffle as well: a large class costs no more.
    first = own.groupBy(F.coalesce("root", "fp").alias("class")).agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key", "key2")).alias("first"))
    kept = saved(first.select("first.key", "first.key2"), "simhash-kept")
    # The rows are carried as one column, so that no name of theirs can clash.
    held = documents.select(F.struct("*").alias("row"), *keys).join(kept, ["key", "key2"], "left_semi")
    return held.dropDuplicates(["key", "key2"]).select("row.*")
