"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction runs bucket by bucket. Within a bucket it goes in waves: what a
stretch of the array induces is placed at once, and what falls into the same
bucket makes the next stretch, so the work in Python grows with the alphabet
and the longest run of one symbol, and everything else is linear in numpy.
Names of substrings, the symbols of every level below the first, are mostly
rare; there the same induction runs suffix by suffix, linear as well.
"""

from __future__ import annotations

import numpy as np

#: A level whose symbols are rarer than this on average is induced suffix by suffix:
#: buckets of a few suffixes leave numpy nothing to do at once.
LEAST_BUCKET = 64


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique least."""
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(at, n - 2)] > 0
    return smaller


def _place(order: np.ndarray, at: np.ndarray, symbols: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Put ``at`` next to the edges of their symbols' buckets, in order, and move the edges."""
    if not len(at):
        return
    by = np.argsort(symbols, kind="stable")
    s = symbols[by]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, count)
    if down:
        order[edge[s] - 1 - rank] = at[by]
        edge[s[first]] -= count
    else:
        order[edge[s] + rank] = at[by]
        edge[s[first]] += count


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given those at leftmost smaller places (in order, or in any for a first round)."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.full(n, -1, np.int64)
    seeds = np.argsort(text[lms], kind="stable")
    seeded = lms[seeds]
    of = np.concatenate([[0], np.cumsum(np.bincount(text[lms], minlength=len(sizes)))])
    head = starts.copy()
    present = np.flatnonzero(sizes)
    for c in present:
        low = starts[c]
        while low < head[c]:
            block = order[low: head[c]] - 1
            low = head[c]
            block = block[block >= 0]
            block = block[~smaller[block]]
            _place(order, block, text[block], head, False)
        block = seeded[of[c]: of[c + 1]] - 1
        block = block[block >= 0]
        _place(order, block, text[block], head, False)
    tail = ends.copy()
    for c in present[::-1]:
        high = ends[c]
        while high > tail[c]:
            block = order[tail[c]: high][::-1] - 1
            high = tail[c]
            block = block[block >= 0]
            block = block[smaller[block]]
            _place(order, block, text[block], tail, True)
        block = order[starts[c]: head[c]][::-1] - 1
        block = block[block >= 0]
        block = block[smaller[block]]
        _place(order, block, text[block], tail, True)
    order[0] = n - 1  # the last suffix is induced by none
    return order


def _induce_rare(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``_induce`` gives, suffix by suffix: for alphabets whose buckets hold a few suffixes each."""
    ends = np.cumsum(sizes)
    head, tail = (ends - sizes).tolist(), ends.tolist()
    # The symbol before each suffix if the suffix there is greater (smaller) than this one, else -1.
    before = np.concatenate([[-1], text[:-1]])
    falls = np.where(np.concatenate([[True], smaller[:-1]]), -1, before).tolist()
    rises = np.where(np.concatenate([[False], smaller[:-1]]), before, -1).tolist()
    order = [0] * len(text)  # a place still free induces nothing, as nothing is before suffix 0
    for at, c in zip(lms[::-1].tolist(), text[lms[::-1]].tolist()):
        tail[c] -= 1
        order[tail[c]] = at
    for at in order:  # it grows ahead of the place that is read
        c = falls[at]
        if c >= 0:
            order[head[c]] = at - 1
            head[c] += 1
    tail = ends.tolist()
    for at in reversed(order):
        c = rises[at]
        if c >= 0:
            tail[c] -= 1
            order[tail[c]] = at - 1
    return np.array(order)


def _name(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of sorted substrings that start at ``lms``: equal ones share a name."""
    n = len(text)
    same = length[1:] == length[:-1]
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        a, b = lms[active] + k, lms[active + 1] + k
        inside = k < length[active]
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        differs = inside & ((text[a] != text[b]) | (smaller[a] != smaller[b]))
        same[active[differs]] = False
        active = active[inside & ~differs]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes. ``text`` holds integers of 0 and up and ends in its only 0."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    sizes = np.bincount(text)
    rare = n < LEAST_BUCKET * np.count_nonzero(sizes)
    induce = _induce_rare if rare else _induce
    smaller = suffix_types(text)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induce(text, smaller, lms, sizes)
    length = np.empty(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)  # up to and with the next such place
    rough = induce(text, smaller, lms, sizes)
    in_order = rough[is_lms[rough]]
    names = _name(text, smaller, in_order, length[in_order])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[in_order] = names
        in_order = lms[suffix_array(reduced[lms])]
    return induce(text, smaller, in_order, sizes)


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the length it shares with the one before it in ``order``.

    Where the symbols before both suffixes agree, the length is one less than
    at the place before; only the other places are compared symbol by symbol.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    i = np.arange(1, n)
    j = before[1:]
    irreducible[1:] = (j <= 0) | (text[i - 1] != text[np.maximum(j, 1) - 1])
    shared = np.zeros(n, np.int64)
    active = np.flatnonzero(irreducible & (before >= 0))
    k = 0
    while len(active):  # the only 0 is at the end, so no comparison runs past it
        active = active[text[active + k] == text[before[active] + k]]
        k += 1
        shared[active] = k
    at = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return np.where(irreducible, shared, shared[at] - (np.arange(n) - at))
