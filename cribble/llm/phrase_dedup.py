"""Removing passages of words that occur in earlier transcripts, with phrase automata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.passages import Unit, covered, repeated_spans, runs_of
from cribble.llm.shared import NULL_ID
from cribble.llm.words import AS_IS, NOT_SPACE, Rolling, Words, buffers

SPAN = 50
#: Segments that are numbered together, and matches that are compared together.
STREAM = 2_000
MATCHES = 5_000


def _comparing(span: int):
    """The passages of a shard: stretches of windows found under different ids.

    Windows are told by 128 bits of hash; each different one lies in one passage.
    """
    rolls = Rolling(21), Rolling(22)

    def confirm(table: pa.Table) -> pa.Table:
        data, bounds = buffers(pc.binary_join_element_wise(table.column("seg"), pa.scalar(b"\n"), pa.scalar(b"")))
        words = Words(data, bounds, NOT_SPACE, AS_IS)
        ids, twin = table.column("id").to_numpy(), table.column("twin").to_numpy()
        both = np.stack([rolls[0].grams(words.hashes, span),
                         rolls[1].grams(Words(data, bounds, NOT_SPACE, AS_IS, 2).hashes, span)])
        owner = words.text_of()[: both.shape[1]]
        at = np.flatnonzero(np.arange(both.shape[1]) + span <= words.first[owner + 1])
        order = np.lexsort((at, both[1][at], both[0][at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (both[:, at[1:]] != both[:, at[:-1]]).any(0)
        first = np.flatnonzero(new)
        passages, least = [], []
        if len(first):
            low, high = np.minimum.reduceat(ids[owner[at]], first), np.maximum.reduceat(ids[owner[at]], first)
            recurs = (low != high) | np.logical_or.reduceat(twin[owner[at]], first)
            mine, held = at[first[recurs]], low[recurs]
            order = np.argsort(mine)
            mine, held = mine[order], held[order]
            cut = np.flatnonzero((np.diff(mine) != 1) | np.diff(owner[mine])) + 1
            for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(mine))):
                if a < b:
                    passages.append(data[words.starts[mine[a]]: words.ends[mine[b - 1] + span - 1]].tobytes())
                    least.append(held[a:b].astype(np.int64).tobytes())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(passages), pa.int64()),
                         "passage": pa.array(passages, pa.binary()), "least": pa.array(least, pa.binary())})

    return confirm


class Phrases:
    """Passages of words compiled into an automaton over their consecutive tiles.

    Each word of the passages is one character to the automaton, other words are
    character 0, and a tile knows the places where it stands. Every window of
    ``2 * tile`` words or more of a passage contains a whole tile, and the
    automaton has about as many nodes as the passages have words.
    """

    def __init__(self, passages: list[bytes], least: list[bytes], span: int):
        import ahocorasick

        self.span, self.tile = span, span // 2
        rows = [p.split() for p in passages]
        self.number: dict[bytes, int] = {}
        for row in rows:
            for word in row:
                self.number.setdefault(word, len(self.number) + 1)
        self.flat = np.array([self.number[w] for row in rows for w in row], np.uint32)
        self.bounds = np.cumsum([0] + [len(row) for row in rows])
        self.least = np.frombuffer(b"".join(least), np.int64)
        self.of_least = self.bounds[:-1] - (span - 1) * np.arange(len(rows))
        tiles: dict[str, int] = {}
        places = []
        text = self.flat.tobytes().decode("utf-32-le", "surrogatepass")
        for p in range(len(rows)):
            for at in range(self.bounds[p], self.bounds[p + 1] - self.tile + 1, self.tile):
                places.append((tiles.setdefault(text[at: at + self.tile], len(tiles)), p, at))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, k in tiles.items():
            self.machine.add_word(phrase, k)
        self.machine.make_automaton()
        # The places of a tile by the words before them (few numbers, as tiles are), then by those after, most first.
        key, passage, at = np.array(places, np.int64).reshape(-1, 3).T
        self.rest = span - self.tile
        self.before, group = np.unique(np.minimum(at - self.bounds[passage], self.rest), return_inverse=True)
        after = np.minimum(self.bounds[passage + 1] - at - self.tile, self.rest)
        code = (key * len(self.before) + group) * (self.rest + 1) + self.rest - after
        order = np.argsort(code, kind="stable")
        self.code, self.passage, self.at = code[order], passage[order], at[order]

    def _with_room(self, key: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the places begin that leave room for a window around a tile with so many words before
        and after it, and their number; a row for each of ``self.before``."""
        need = self.rest - np.minimum(before, self.before[:, None])
        first = (key * len(self.before) + np.arange(len(self.before))[:, None]) * (self.rest + 1)
        low = np.searchsorted(self.code, first)
        n = np.searchsorted(self.code, first + self.rest - need, "right") - low
        return low, np.where(after >= need, n, 0)

    def least_ids(self, segs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the joined segments the least id whose text holds the window
        from there on (the greatest integer: none known), and where segments begin.

        Segments of ``sizes`` words are joined with one place between them.
        """
        span = self.span
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        found = np.full(int((sizes + 1).sum()), np.iinfo(np.int64).max)
        units = np.zeros(len(found), np.uint32)
        inside = np.ones(len(units), bool)
        inside[begin + sizes] = False
        words = b"\n".join(segs).split()
        units[inside] = np.fromiter(map(self.number.get, words, repeat(0)), np.uint32, len(words))
        hits = np.fromiter(self.machine.iter(units.tobytes().decode("utf-32-le", "surrogatepass")), np.dtype((np.int64, 2)))
        if not len(hits):
            return found, begin
        here, key = hits[:, 0] - self.tile + 1, hits[:, 1]
        of = np.searchsorted(begin, here, "right") - 1
        low, n = self._with_room(key, here - begin[of], begin[of] + sizes[of] - here - self.tile)
        # By hit, so that hits of one match follow each other.
        hit = np.tile(np.arange(len(here)), len(self.before))
        some = np.flatnonzero(n.ravel())
        some = some[np.argsort(hit[some], kind="stable")]
        low, n, hit = low.ravel()[some], n.ravel()[some], hit[some]
        last = np.cumsum(n)
        # One number says which: the offset lies within the length of all passages of the segment.
        width = len(self.flat) + int(sizes.max()) + 1
        for a in range(0, int(n.sum()), MATCHES):
            k = np.arange(a, min(a + MATCHES, int(last[-1])))
            which = np.searchsorted(last, k, "right")
            place = low[which] + k - (last[which] - n[which])
            seg, at = of[hit[which]], here[hit[which]]
            # Hits of one passage at one offset are one match; it is compared word by word.
            match = np.unique((seg * len(self.of_least) + self.passage[place]) * width + (at - begin[seg]) - self.at[place] + len(self.flat))
            rest, offset = np.divmod(match, width)
            seg, passage = np.divmod(rest, len(self.of_least))
            offset += begin[seg] - len(self.flat)
            left = np.maximum(begin[seg], self.bounds[passage] + offset)
            right = np.minimum(begin[seg] + sizes[seg], self.bounds[passage + 1] + offset)
            long = right - left - span + 1  # windows that both could hold
            room = right - left
            step = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            word = np.repeat(left, room) + step
            differs = units[word] != self.flat[word - np.repeat(offset, room)]
            sums = np.concatenate([[0], np.cumsum(differs)])
            step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            start = np.repeat(np.cumsum(room) - room, long) + step
            same = sums[start + span] == sums[start]
            window = (np.repeat(left, long) + step)[same]
            origin = np.repeat(self.of_least[passage] - self.bounds[passage] - offset, long)[same]
            np.minimum.at(found, window, self.least[window + origin])
        return found, begin


def _locating(span: int):
    """Streams a part of the segments through the automaton of their shard's passages."""

    def locate(passages: pa.Table, table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not passages.num_rows or not table.num_rows:
            return runs_of(none, none, none)
        phrases = Phrases(passages.column("passage").to_pylist(), passages.column("least").to_pylist(), span)
        out = []
        for k in range(0, table.num_rows, STREAM):
            rows = table.slice(k, STREAM)
            ids, part, start, run = (rows.column(c).to_numpy() for c in ("id", "part", "start", "run"))
            found, begin = phrases.least_ids(rows.column("seg").to_pylist(), run.astype(np.int64) + span - 1)
            owner = np.searchsorted(begin, np.arange(len(found)), "right") - 1
            at = np.flatnonzero(found < ids[owner])
            owner = owner[at]
            out.append(runs_of(ids[owner], part[owner], start[owner] + at - begin[owner]))
        return pa.concat_tables(out)

    return locate


def _removing(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            at = batch.column("spans").offsets.to_numpy()
            start, n = (batch.column("spans").values.field(k).to_numpy() for k in (0, 1))
            kept, sizes, removed = [], [], []
            for k, text in enumerate(texts):
                words = text.split()
                sizes.append(len(words))
                if at[k] < at[k + 1]:
                    gone = covered(start[at[k]: at[k + 1]], n[at[k]: at[k + 1]], span, len(words))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words))
                removed.append(sizes[-1] - len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], ["id", "text", "n_words", "n_removed"])

    return run


def remove_repeated_phrases(transcripts: DataFrame, span: int = SPAN) -> DataFrame:
    """Remove each word inside ``span`` consecutive words that an earlier transcript holds too.

    ``transcripts``: ``id, text``; other columns are ignored. Words are
    separated by ASCII white space and compared as they are; earlier means a
    smaller id; windows are judged on the input. Segments that may recur are
    dealt into shards by anchor (see ``passages``). In a shard, passages found
    under different ids are confirmed by hashes and compiled into an automaton, and
    all segments with the shard's anchors, exact copies included, stream
    through it in as many tasks as they need, to locate every occurrence.
    Only where an anchor has over ``passages.WIDE`` different segments do hashes
    of windows decide alone.

    Returns one row per input row: ``id, text`` (words left, joined by one
    space), ``n_words`` (before), ``n_removed``. A null or empty text has no
    words. A null id comes before all others. Rows with the same id do not
    count as earlier than each other.
    """
    unit = Unit(words=True, span=span, gram=max(1, span // 4), across=True)
    _, rows = repeated_spans(transcripts, unit, "phrases", _comparing(span), _locating(span))
    return rows.mapInArrow(
        _removing(span), "id bigint, text string, n_words bigint, n_removed bigint",
    ).withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
