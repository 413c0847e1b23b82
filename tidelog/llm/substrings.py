"""Exact removal of repeated substrings: suffix arrays over the places where repeats can be.

Every LENGTH-byte window has an anchor, the ANCHOR-byte string in it with the smallest hash (the leftmost of equal ones).
Equal windows have equal anchors at equal places, so a repeat is found among the windows around equal anchors. A run of
windows with one anchor is a segment. Then, in this order:

1. Each batch of documents keeps, of segments with equal anchor and content, the first; the later ones are repeats as a
   whole. The rest goes, packed by anchor range, to the range's task, which does the same across documents.
2. Segments with equal anchor and different content may share some windows. In a window of two such segments at least
   CONTEXT bytes to the right or to the left of the anchor are equal as well, so segments meet in groups of equal anchor
   and right context, and of equal anchor and left context; those alone in both are done.
3. For small groups the segments are laid end to end and their suffix array is constructed by linear grouping (gsaca);
   neighbours in it that agree in LENGTH bytes are equal windows, of which all but the first are repeats.
4. Larger groups (a passage that very many documents share) would make one task grow. Their windows are compared by
   128-bit hash instead, first in the batch, then across batches, in groups that each keep one row.

Segments are compared by 128 bits of hashes of anchor and content, then per document all repeats are united and cut out.

Documents are ordered by doc_id, a null one first; of rows that share a doc_id, the order is that of a hash of their texts,
and rows with the same id and text are one document (each gets its result). A null text is empty. An empty table gives an empty result. Extra columns are
ignored. Texts are UTF-8 bytes, whole, of any length; texts under LENGTH bytes have no repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import arrow_rows, saved
from tidelog.llm.gsaca import suffix_arrays

LENGTH = 100
ANCHOR = 32
CONTEXT = 32
# Bytes of text that a task takes apart together, and bytes of text per anchor range.
BATCH_BYTES = 3 << 20
RANGE_BYTES = 6 << 20
# Segments whose suffix array is constructed; larger groups go by hash.
GROUP = 12
# Symbols laid side by side for suffix arrays.
LAYOUT = 200_000
# Documents that are handed to a task's Python at a time.
ROWS = 1000
# Starts of windows handled at a time within one long text (positions share a word with hashes).
PIECE = 1_000_000

FACTOR = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.frombuffer(hashlib.shake_128(b"bytes").digest(2048), np.uint64)
ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("start", "<i4"), ("anchor", "u1"), ("more", "u1"), ("right", "<u2"), ("left", "<u2")])
SPAN_ROW = np.dtype([("doc", "<i8"), ("tie", "<i4"), ("start", "<i8"), ("stop", "<i8")])


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` (a power of two) bytes that begin at each place."""
    hashes, factor, done = TABLE[data], int(FACTOR), 1
    while done < width:
        hashes = hashes[:-done] * np.uint64(factor) + hashes[done:]
        factor, done = factor * factor % 2**64, done * 2
    mixed = (hashes ^ (hashes >> np.uint64(29))) * FACTOR
    return mixed ^ (mixed >> np.uint64(32))


def lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the `width` keys that begin at each place."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if width > done else keys


def segments(data: bytes) -> dict[str, np.ndarray]:
    """key, content, start, anchor (from start), more (windows after the first), right and left contexts of a text's segments."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("key", "content", "start", "anchor", "more", "right", "left")}
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, PIECE):
        hashes = rolled(whole[at : at + PIECE + LENGTH - 1], ANCHOR)
        places = np.arange(len(hashes), dtype=np.uint64)
        mask = np.uint64((1 << 20) - 1)
        anchors = (lowest(hashes & ~mask | places, LENGTH - ANCHOR + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        last = np.append(first[1:] - 1, len(anchors) - 1)
        anchor = anchors[first]
        content = (anchor - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)
        for begin in (first, last):  # the first and the last window cover the segment
            for step in (0, 32, 64, LENGTH - 32):
                content = (content ^ hashes[begin + step]) * FACTOR
                content ^= content >> np.uint64(31)
        # Contexts outside this piece are missing for windows of this piece as well.
        right, left = anchor + ANCHOR, anchor - CONTEXT
        has_right, has_left = right < len(hashes), left >= 0
        # Anchors have small hashes; multiplied by an odd number they are as distinct, and spread over all ranges.
        spread = hashes[anchor] * FACTOR
        out["key"].append(spread ^ (spread >> np.uint64(32)))
        out["content"].append(content)
        out["start"].append(first + at)
        out["anchor"].append(anchor - first)
        out["more"].append(last - first)
        out["right"].append(np.where(has_right, hashes[np.minimum(right, len(hashes) - 1)], hashes[anchor] ^ places[first]) >> np.uint64(48))
        out["left"].append(np.where(has_left, hashes[np.maximum(left, 0)], hashes[anchor] ^ places[first]) >> np.uint64(48))
    return {name: np.concatenate(parts) if parts else np.empty(0, np.int64) for name, parts in out.items()}


def resolved(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entries of each anchor and content, the later ones), both sorted by anchor, content and place."""
    entries = entries[np.lexsort((entries["start"], entries["tie"], entries["doc"], entries["content"], entries["key"]))]
    if not len(entries):
        return entries, entries
    fresh = np.ones(len(entries), bool)
    fresh[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["content"][1:] != entries["content"][:-1])
    head = entries[np.maximum.accumulate(np.where(fresh, np.arange(len(entries)), 0))]
    # The same place twice is a repeated row of the table, not a repeat.
    same = (head["doc"] == entries["doc"]) & (head["tie"] == entries["tie"]) & (head["start"] == entries["start"])
    return entries[fresh], entries[~same]


def meetings(firsts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per side, (entries, group, group size, first start, last start) of the segments that share anchor and context there.

    A window with its anchor at most (LENGTH - ANCHOR) / 2 bytes in has CONTEXT bytes right of it, any other left of it.
    """
    half = (LENGTH - ANCHOR) // 2
    out = []
    several = np.isin(firsts["key"], _repeated(firsts["key"]))
    firsts = firsts[several]
    for side in ("right", "left"):
        start, last = firsts["start"].astype(np.int64), firsts["start"].astype(np.int64) + firsts["more"]
        anchor = start + firsts["anchor"]
        if side == "right":
            start = np.maximum(start, anchor - half)
        else:
            last = np.minimum(last, anchor - half - 1)
        fit = start <= last
        group = (firsts["key"] ^ (firsts[side].astype(np.uint64) + np.uint64(1 + (side == "left") * 65536))) * FACTOR
        unique, at, count = np.unique(group[fit], return_inverse=True, return_counts=True)
        met = count[at] > 1
        out.append((firsts[fit][met], group[fit][met].view(np.int64), count[at][met], start[fit][met], last[fit][met]))
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    unique, count = np.unique(keys, return_counts=True)
    return unique[count > 1]


def shared_windows(groups: np.ndarray, owners: np.ndarray, starts: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """(row, offset) of the windows equal to a window of an earlier row, or of the same row earlier, in their group.

    Rows are sorted by group and, inside, by place of their documents: `owners` (of equal documents) and starts order them.
    """
    if not len(groups):
        return np.empty((0, 2), np.int64)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    begin = np.cumsum(sizes) - sizes
    # Per group one text: its bodies, each with a separator behind it, the last of which ends the text.
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    row = np.repeat(np.arange(len(bodies)), sizes)
    offset = np.arange(len(data)) - begin[row]
    separator = offset == sizes[row] - 1
    data[separator] = 1
    change = np.flatnonzero(np.concatenate((groups[1:] != groups[:-1], [True])))
    data[begin[change] + sizes[change] - 1] = 0
    lengths = np.add.reduceat(sizes, np.concatenate(([0], change[:-1] + 1)))
    order = suffix_arrays(data, lengths)
    order = order[offset[order] <= sizes[row[order]] - 1 - LENGTH]
    if len(order) < 2:
        return np.empty((0, 2), np.int64)
    # Neighbours of one text that agree in LENGTH bytes are one class of equal windows.
    words = np.lib.stride_tricks.sliding_window_view(data.astype(np.uint8), LENGTH)
    equal = np.zeros(len(order) - 1, bool)
    text = groups[row[order]]
    near = np.flatnonzero((text[1:] == text[:-1]) & (data[order[1:]] == data[order[:-1]]) & (data[order[1:] + LENGTH - 1] == data[order[:-1] + LENGTH - 1]))
    for at in range(0, len(near), 20_000):
        part = near[at : at + 20_000]
        equal[part] = (words[order[part]] == words[order[part + 1]]).all(axis=1)
    label = np.cumsum(np.concatenate(([True], ~equal)))
    # Of a class the window of the first place stays; the same place in two rows is one place.
    place = np.lexsort((starts[row[order]] + offset[order], owners[row[order]], label))
    kept = order[place]
    first = np.concatenate(([True], label[place][1:] != label[place][:-1]))
    head = kept[np.maximum.accumulate(np.where(first, np.arange(len(kept)), 0))]
    position = starts[row] + offset
    same = (owners[row[head]] == owners[row[kept]]) & (position[head] == position[kept])
    again = kept[~same]
    return np.stack((row[again], offset[again]), axis=1)


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal runs, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
    at = np.flatnonzero(fresh)
    return starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)]


def _spans(doc: np.ndarray, tie: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """doc, tie, start, stop: the spans of each document as maximal runs."""
    order = np.lexsort((starts, tie, doc))
    doc, tie, starts, ends = doc[order], tie[order], starts[order], ends[order]
    if len(doc):
        border = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
        # Shifting every document beyond the last keeps runs inside their documents.
        shift = (np.cumsum(border) - 1) * (int(ends.max()) + 2)
        first, last = united(starts + shift, ends + shift)
        at = np.searchsorted(starts + shift, first)
        doc, tie, starts, ends = doc[at], tie[at], first - shift[at], last - shift[at]
    return pd.DataFrame({"doc": doc, "tie": tie, "start": starts, "stop": ends})


def _named(documents: DataFrame) -> DataFrame:
    """doc and tie (the order of documents and what they are known by) and text."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce("doc_id", F.lit(-(2**63)))
    return documents.select(doc.alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tie"), text.alias("text"))


def _entries_of(frame: pd.DataFrame) -> np.ndarray:
    parts = []
    for doc, tie, text in zip(frame["doc"].tolist(), frame["tie"].tolist(), frame["text"], strict=True):
        found = segments(text.encode())
        own = np.empty(len(found["key"]), ENTRY)
        for name, values in found.items():
            own[name] = values
        own["doc"], own["tie"] = doc, tie
        parts.append(own)
    return np.concatenate(parts) if parts else np.empty(0, ENTRY)


def _batches(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        size = frame["text"].str.len().to_numpy(np.int64)
        for _, part in frame.groupby(np.cumsum(size) // limit, sort=True):
            yield part


def anchored(documents: DataFrame, ranges: int) -> DataFrame:
    """Segments by anchor range, packed, and (in any range) the spans that a batch already knows to be repeats."""
    borders = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, frame in enumerate(_batches(frames, BATCH_BYTES)):
            firsts, later = resolved(_entries_of(frame))
            spans = _whole_spans(later).to_records(index=False, column_dtypes=dict(SPAN_ROW.descr)).tobytes()
            cut = np.append(np.searchsorted(firsts["key"], borders), len(firsts))
            rows = [(part, firsts[cut[part] : cut[part + 1]].tobytes(), b"") for part in np.flatnonzero(np.diff(cut)).tolist()]
            yield pd.DataFrame([*rows, (number % ranges, b"", spans)], columns=["part", "packed", "spans"])

    return _named(documents).mapInPandas(run, "part int, packed binary, spans binary")


def _whole_spans(later: np.ndarray) -> pd.DataFrame:
    start = later["start"].astype(np.int64)
    return _spans(later["doc"], later["tie"], start, start + later["more"] + LENGTH)


MEET = "doc long, tie int, start long, stop long, group long, members int"


def across(frame: pd.DataFrame) -> pd.DataFrame:
    """Of an anchor range: repeated segments (members = 0), and the segments that meet in groups."""
    known = pd.DataFrame(np.frombuffer(b"".join(frame["spans"]), SPAN_ROW))
    firsts, later = resolved(np.frombuffer(b"".join(frame["packed"]), ENTRY))
    out = [spans.assign(group=0, members=0) for spans in (known, _whole_spans(later))]
    for entries, group, members, first, last in meetings(firsts):
        out.append(pd.DataFrame({"doc": entries["doc"], "tie": entries["tie"], "start": first, "stop": last + LENGTH, "group": group, "members": members}))
    return pd.concat(out, ignore_index=True)


BODY = "doc long, tie int, start long, stop long, group long, kind int, body binary, low long, high long"
SPAN, SEGMENT, WINDOW = 0, 1, 2


def _bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts the meeting segments out of their documents; segments of large groups become windows, the first of each hash."""
    for frame in frames:
        rows, windows = [], {}
        spans: dict[tuple[int, int], list[int]] = {}
        for doc, tie, text, wanted in zip(frame["doc"].tolist(), frame["tie"].tolist(), frame["text"], frame["wanted"], strict=True):
            data = text.encode()
            for want in wanted.split(","):
                start, stop, group, members = map(int, want.split())
                if members <= GROUP:
                    rows.append((doc, tie, start, stop, group, SEGMENT, data[start:stop], 0, 0))
                    continue
                for at in range(start, stop - LENGTH + 1):
                    code = xxhash.xxh3_128_intdigest(data[at : at + LENGTH])
                    here, there = (doc, tie, at), windows.get(code)
                    if there is None or here < there:
                        windows[code] = here
                        here, there = there, here
                    if here is not None and here != there:
                        spans.setdefault(here[:2], []).append(here[2])
            if len(rows) >= 20_000:
                yield _body_rows(rows)
                rows = []
        for (doc, tie), starts in spans.items():
            first, last = united(np.array(starts), np.array(starts) + LENGTH)
            rows += [(doc, tie, a, b, 0, SPAN, None, 0, 0) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        half = 1 << 63
        rows += [(*at, at[2] + LENGTH, 0, WINDOW, None, (code & (2 * half - 1)) - half, (code >> 64) - half) for code, at in windows.items()]
        yield _body_rows(rows)


def _body_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BODY.split(", ")])


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats inside small groups, by suffix array; the frames are sorted by group."""
    held: list[pd.DataFrame] = []

    def flush(part: pd.DataFrame) -> pd.DataFrame:
        # Groups of like size side by side: the steps of a layout are those of its longest text.
        part = part.assign(many=part.groupby("group")["group"].transform("size")).sort_values(["many", "group", "doc", "tie", "start"], kind="stable")
        found = []
        for _, own in part.groupby("many"):
            size = own["body"].str.len().to_numpy(np.int64)
            group = own["group"].to_numpy(np.int64)
            ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
            run = np.cumsum(size)[ends - 1] // LAYOUT
            cuts = np.concatenate(([0], ends[np.flatnonzero(np.concatenate((run[1:] != run[:-1], [True])))]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                block = own.iloc[a:b]
                owner = block.groupby(["doc", "tie"], sort=True).ngroup().to_numpy(np.int64)
                starts = block["start"].to_numpy(np.int64)
                again = shared_windows(block["group"].to_numpy(np.int64), owner, starts, block["body"].tolist())
                at = starts[again[:, 0]] + again[:, 1]
                found.append(_spans(block["doc"].to_numpy(np.int64)[again[:, 0]], block["tie"].to_numpy(np.int64)[again[:, 0]], at, at + LENGTH))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"doc": [], "tie": [], "start": [], "stop": []}, dtype="int64")

    count = 0
    for frame in frames:
        held.append(frame)
        count += int(frame["body"].str.len().sum())
        if count > 10 * LAYOUT:
            part = pd.concat(held, ignore_index=True)
            open_group = part["group"] == part["group"].iloc[-1]
            if not open_group.all():
                yield flush(part[~open_group])
            held = [part[open_group]]
            count = int(held[0]["body"].str.len().sum())
    if held:
        yield flush(pd.concat(held, ignore_index=True))


def repeats(documents: DataFrame) -> DataFrame:
    """doc, tie, start, stop: spans whose union per document is every byte in a window that also starts earlier."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    with arrow_rows(documents.sparkSession, ROWS):
        met = saved(anchored(documents, ranges).groupBy("part").applyInPandas(across, MEET), "segments-met")
    wanted = met.where("members > 0").groupBy("doc", "tie").agg(F.array_join(F.collect_list(F.concat_ws(" ", "start", "stop", "group", "members")), ",").alias("wanted"))
    texts = _named(documents).join(wanted, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    with arrow_rows(documents.sparkSession, ROWS):
        cut = saved(texts.select("doc", "tie", "text", "wanted").mapInPandas(_bodies, BODY), "segment-bodies")
    small = cut.where(F.col("kind") == SEGMENT).select("doc", "tie", "start", "group", "body")
    tasks = max(12, 2 * ranges)
    small = small.repartition(tasks, "group").sortWithinPartitions("group").mapInPandas(_compared, "doc long, tie int, start long, stop long")
    windows = cut.where(F.col("kind") == WINDOW).select("doc", "tie", "start", "stop", "low", "high")
    place = F.struct("doc", "tie", "start")
    first = windows.groupBy("low", "high").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    large = windows.join(first, ["low", "high"]).where(place != F.col("first"))
    spans = ["doc", "tie", "start", "stop"]
    out = met.where("members = 0").select(*spans)
    return out.union(small.select(*spans)).union(cut.where(F.col("kind") == SPAN).select(*spans)).union(large.select(*spans))


def cut_out(texts: pd.Series, spans: pd.Series) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, bytes]]:
    """(bytes, starts and ends of maximal removed runs, kept bytes) per text."""
    for text, own in zip(texts, spans, strict=True):
        data = text.encode()
        if own is None or not len(own):
            yield data, np.empty(0, np.int64), np.empty(0, np.int64), data
            continue
        starts, ends = united(np.array([s["start"] for s in own]), np.array([s["stop"] for s in own]))
        edges = np.concatenate(([0], np.stack((starts, ends), axis=1).ravel(), [len(data)])).tolist()
        yield data, starts, ends, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_repeats(documents: DataFrame) -> DataFrame:
    """The documents' ids and texts (null as empty) with `spans`, the repeated spans of each (null if none)."""
    gathered = repeats(documents).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = _named(documents.select("doc_id", "text")).join(gathered, ["doc", "tie"], "left")
    return texts.select(F.when(F.col("doc") > -(2**63), F.col("doc")).alias("doc_id"), "text", "spans")


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id and text without the repeats. Bytes of a character that is cut apart are left out with the rest of it."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([left.decode("utf-8", "ignore") for *_, left in cut_out(texts, spans)])

    return with_repeats(documents).select("doc_id", kept("text", "spans").alias("text"))


def op6(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(len(data), int((b - a).sum()), len(a), hashlib.sha256(left).hexdigest()) for data, a, b, left in cut_out(texts, spans)]
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_repeats(documents).select("doc_id", digest("text", "spans").alias("found"))
    with arrow_rows(documents.sparkSession, ROWS):
        return saved(found.select("doc_id", "found.*"), "kept-digests")
