"""Suffix arrays by linear grouping, for many short texts side by side.

First all suffixes of a text are grouped by their longest Lyndon prefix. Groups are taken in descending order; for every
suffix of a group its previous-smaller pointer (the nearest earlier suffix of a lower group) is found by following the
pointers already known, and the suffixes pointed at move out of their group into new ones right above it, those pointed
at most often highest. Then the order inside the groups is emitted from left to right: the suffix before each emitted one,
and those it points back to, take the next free places of their groups. Nothing is renamed or sorted recursively.

Each step runs for all texts at once on numpy arrays, so the number of steps is that of the longest text.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array of every text, one after the other, as positions in `symbols`.

    `symbols` holds the texts in a row, `sizes` their lengths (at least 1); each text ends in its own smallest symbol.
    """
    total, texts = len(symbols), len(sizes)
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(texts), sizes)
    place = np.lexsort((symbols, text))  # suffixes by group
    where = np.empty(total, np.int64)
    where[place] = np.arange(total)
    fresh = np.ones(total, bool)
    fresh[1:] = (symbols[place[1:]] != symbols[place[:-1]]) | (text[place[1:]] != text[place[:-1]])
    begins = np.flatnonzero(fresh)
    size = np.zeros(total, np.int64)  # of the group that begins here
    size[begins] = np.diff(np.append(begins, total))
    group = np.empty(total, np.int64)  # where the suffix's group begins
    group[place] = np.repeat(begins, size[begins])
    before = np.full(total, -1)  # previous-smaller pointers
    end = base + sizes
    active = np.arange(texts)
    while len(active):
        top = end[active]
        low = group[place[top - 1]]
        counts = top - low
        spread = np.cumsum(counts)
        members = place[np.arange(spread[-1]) + np.repeat(low - (spread - counts), counts)]
        pointed = _point_back(members, np.repeat(low, counts), np.repeat(base[active], counts), group, before)
        before[members] = pointed
        marked, often = np.unique(pointed[pointed >= 0], return_counts=True)
        for times in range(int(often.max(initial=0)), 0, -1):
            _move_up(marked[often == times], place, where, group, size)
        end[active] = low
        active = active[low > base[active]]
    return _emit(sizes, base, group, before)


def _point_back(members, own, first, group, before) -> np.ndarray:
    """For each member the nearest earlier suffix of its text in a lower group, or -1."""
    at = members - 1
    at[at < first] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        here = at[todo]
        theirs = group[here]
        higher, equal = theirs > own[todo], theirs == own[todo]
        step = np.where(higher, before[here], here - equal)
        step[step < first[todo]] = -1
        at[todo] = step
        todo = todo[(higher | equal) & (step >= 0)]
    return at


def _move_up(suffixes, place, where, group, size) -> None:
    """Takes the suffixes out of their groups; those of one group form a new group right above what is left of it."""
    if not len(suffixes):
        return
    suffixes = suffixes[np.argsort(group[suffixes], kind="stable")]
    old, first, counts = np.unique(group[suffixes], return_index=True, return_counts=True)
    part = counts < size[old]
    if not part.any():
        return
    keep = np.repeat(part, counts)
    suffixes, old, counts = suffixes[keep], old[part], counts[part]
    new = old + size[old] - counts
    size[old] -= counts
    size[new] = counts
    target = np.repeat(new, counts)
    # Members already in the new group's places stay; the others swap with the strangers there.
    outside = suffixes[where[suffixes] < target]
    spread = np.cumsum(counts)
    spots = np.arange(spread[-1]) + np.repeat(new - (spread - counts), counts)
    group[suffixes] = target
    strangers = place[spots][group[place[spots]] != target]
    a, b = where[outside], where[strangers]
    place[b], place[a] = outside, strangers
    where[outside], where[strangers] = b, a


def _emit(sizes, base, group, before) -> np.ndarray:
    total = len(group)
    out = np.full(total, -1)
    free = np.arange(total)  # next free place of the group that begins here
    done = np.zeros(total, bool)
    last = base + sizes - 1
    out[base] = last
    done[last] = True
    free[group[last]] += 1
    order = np.argsort(-sizes, kind="stable")
    base, sizes = base[order], sizes[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than `step`
        head = base[:live]
        suffix = out[head + step] - 1
        suffix = suffix[suffix >= head]
        suffix = suffix[~done[suffix]]
        while len(suffix):
            mine = group[suffix]
            out[free[mine]] = suffix
            free[mine] += 1
            done[suffix] = True
            suffix = before[suffix]
            suffix = suffix[suffix >= 0]
            suffix = suffix[~done[suffix]]
    return out
