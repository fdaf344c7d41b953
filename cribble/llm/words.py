"""Words and rolling hashes of a whole Arrow batch of texts at once, in numpy.

All arithmetic is modulo 2**64. The hash of a sequence x is the sum of
``table[x_j] * P**j``, so that any run's hash comes from two prefix sums and a
power of the inverse of P; a bit mixer makes the sums fit for comparing sizes.
Texts are taken as UTF-8 bytes and looked at in pieces of about ``PIECE``
bytes, which bounds what lies in memory beside the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21

SPACES = b" \t\n\x0b\x0c\r"
LETTERS = bytes(range(ord("a"), ord("z") + 1))
DIGITS = bytes(range(ord("0"), ord("9") + 1))

#: Word characters: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
#: Word characters: letters, digits and everything beyond ASCII.
ALNUM = np.arange(256) >= 128
ALNUM[list(LETTERS + DIGITS + LETTERS.upper())] = True

AS_IS = np.arange(256)
LOWER = np.arange(256)
LOWER[list(LETTERS.upper())] = list(LETTERS)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of runs of a sequence of 64-bit values."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(0, 2**63, dtype=np.int64)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.table = rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, p in (("up", self.base), ("down", self.inverse)):
                step = np.full(size, p, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        """Mixed hashes of ``[starts, ends)`` from ``prefix`` sums."""
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def grams(self, values: np.ndarray, k: int) -> np.ndarray:
        """The hash of each k consecutive values."""
        if len(values) < k:
            return np.zeros(0, np.uint64)
        sums = self.prefix(values)
        n = len(values) - k + 1
        return mixed((sums[k:] - sums[:n]) * self.down[:n])


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def portions(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; one text at least."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of many texts in a row: ``starts``, ``ends`` (bytes), ``hashes``;
    text i has the words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, letters: np.ndarray,
                 fold: np.ndarray = AS_IS, seed: int = 1):
        roll, parts = Rolling(seed), []
        table = roll.table[fold]
        at, end = 0, len(data)
        while at < end:
            to = min(end, at + PIECE)
            while to < end and letters[data[to - 1]]:  # a word is not cut
                gap = np.flatnonzero(~letters[data[to: to + PIECE]])
                to = to + int(gap[0]) if len(gap) else min(end, to + PIECE)
                if to < end and not letters[data[to]]:
                    break
            inside = letters[data[at:to]]
            cuts = bounds[np.searchsorted(bounds, at): np.searchsorted(bounds, to)] - at
            begins, stops = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[cuts] = inside[cuts]
            stops[:-1] &= ~inside[1:]
            before = cuts[cuts > 0] - 1
            stops[before] = inside[before]
            s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            parts.append((s + at, e + at, roll.runs(roll.prefix(table[data[at:to]]), s, e)))
            at = to
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*(parts or [none])))
        self.first = np.searchsorted(self.starts, bounds)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def same_text(first: np.ndarray, span: int) -> np.ndarray:
    """Of each unit: do ``span`` units from it on lie in its text? ``first`` as in ``Words``."""
    ok = np.zeros(int(first[-1]), bool)
    for a, b in zip(first[:-1], first[1:]):
        ok[a: max(a, b - span + 1)] = True
    return ok
