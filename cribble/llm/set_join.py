"""Joining transcripts whose sets of word shingles are nearly the same.

Equal sets are one set. Sets are indexed by the rarest tenth or so of their
shingles, which similar sets must share; index lists are ordered by size and
read in blocks that are skipped when no place in them can reach the overlap
asked for. Sets that meet are first compared with one leader; the answers of
others are derived from the leader's by the few shingles in which they differ,
and the distance to the leader decides most later pairs without their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribble.llm.shared import id_or_null, keyed, settle
from cribble.llm.words import LOWER, NOT_SPACE, Rolling, Words, buffers, mixed, portions

WIDTH = 3
PERCENT = 90
#: Words and shingles are counted in so many cells to estimate how rare a shingle is. The
#: estimate only sets the order of shingles; any order gives the same links.
WORD_BITS = 17
SHINGLE_BITS = 20
#: Sets of LONG shingles or more have prefixes longer by MORE, so similar ones share MORE + 1 of them.
LONG, MORE = 40, 3
#: Bits of a set's sketch: the parity of how many of its shingles fall on each.
SKETCH = 512
#: Bits of the filter that keeps texts nobody asks for out of a join (2 MB).
FILTER_BITS = 24
PIVOTS = 64
GROUP = 5_000
BLOCK = 64
#: Members of the prefix before an entry by which a pair is seen to have met before.
BEFORE = 8
#: Candidate pairs of a list that are held before they are given on; one block of pairs more at most.
PAIRS = 1 << 16


def rarity(logs: np.ndarray, total: float) -> np.ndarray:
    """Rank of runs of words by how often they may occur: at most as often as their rarest
    word, and about as often as chance would join their words (all as base-2 logarithms)."""
    chance = logs.sum(0) - (len(logs) - 1) * total
    return np.clip(4 * np.minimum(logs.min(0), chance), 0, 255).astype(np.uint8)


def shingles(
    data: np.ndarray, bounds: np.ndarray, width: int, logs: tuple | None = None, total: float = 0.0,
) -> tuple[np.ndarray, ...]:
    """Text number, hash and rank (by ``logs``, the counts in the cells of words and of
    shingles) of every run of ``width`` words; a shorter text is one run."""
    words = Words(data, bounds, NOT_SPACE, LOWER)
    grams = Rolling(31)
    size, first = np.diff(words.first), words.first
    text = words.text_of()
    full = grams.grams(words.hashes, width)
    ok = np.flatnonzero(np.arange(len(full)) + width <= first[text[: len(full)] + 1])
    by_word = np.zeros(len(words.hashes), np.float32) if logs is None else logs[0][cells_of(words.hashes, WORD_BITS)]
    owners, hashes, ranks = [text[ok]], [full[ok]], [rarity(np.stack([by_word[ok + j] for j in range(width)]), total)]
    for n in range(1, width):
        short = np.flatnonzero(size == n)
        at = first[short]
        owners.append(short)
        hashes.append(mixed(grams.grams(words.hashes, n)[at] + np.uint64(n)) if len(short) else full[:0])
        ranks.append(rarity(np.stack([by_word[at + j] for j in range(n)]), total))
    owner, found, rank = np.concatenate(owners), np.concatenate(hashes), np.concatenate(ranks)
    if logs is not None:  # what repeats as a whole may be made of common words
        rank = np.maximum(rank, (4 * logs[1][cells_of(found, SHINGLE_BITS)]).astype(np.uint8))
    return owner, found, rank


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _cells(width: int):
    """How many words fall into each cell in this task, and shingles into cells that are
    fuller than chance would make them (numbered behind those of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, runs = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << SHINGLE_BITS, np.int64)
        for batch in batches:
            data, bounds = buffers(batch.column(0))
            for a, b in portions(bounds):
                words = Words(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], NOT_SPACE, LOWER)
                counts += np.bincount(cells_of(words.hashes, WORD_BITS), minlength=len(counts))
                full = Rolling(31).grams(words.hashes, width)
                runs += np.bincount(cells_of(full, SHINGLE_BITS), minlength=len(runs))
        mean = runs.mean()
        counts = np.concatenate([counts, np.where(runs > mean + 4 * mean**0.5 + 2, runs, 0)])
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["cell", "n"])

    return run


SETS = "id bigint, print bigint, n int, s1 bigint, s2 bigint, prefix array<bigint>, sketch binary"


def sketches(text: np.ndarray, h: np.ndarray, texts: int) -> list[bytes]:
    """A sketch of each text's set, given the text and the hash of every member, in order of texts.

    Two sets whose sketches differ in some bits differ in as many members at least.
    """
    bit, out, step = (mixed(h) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), [], 1_000
    for a in range(0, texts, step):
        b = min(texts, a + step)
        x, y = np.searchsorted(text, [a, b])
        counts = np.bincount((text[x:y] - a) * SKETCH + bit[x:y], minlength=(b - a) * SKETCH)
        out += [row.tobytes() for row in np.packbits((counts & 1).astype(bool).reshape(b - a, SKETCH), axis=1)]
    return out


def _sets(width: int, percent: int, logs: tuple[np.ndarray, np.ndarray], total: float):
    """Size, signature and prefix of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = Rolling(41), Rolling(42)
        for batch in batches:
            data, bounds = buffers(batch.column(2))
            for a, b in portions(bounds):
                text, h, rank = shingles(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], width, logs, total)
                order = np.lexsort((h, rank, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                text, h = text[new], h[new]
                first = np.searchsorted(text, np.arange(b - a + 1))
                n = np.diff(first)
                signs = [r.runs(r.prefix(h), first[:-1], first[1:]) for r in rolls]
                length = np.where(n > 0, n - -(-n * percent // 100) + 1 + np.where(n >= LONG, MORE, 0), 0)
                at = np.arange(len(h)) - np.repeat(first[:-1], n)
                in_prefix = at < np.repeat(length, n)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(a, b - a) for k in (0, 1)], pa.array(n.astype(np.int32)), *[pa.array(s.view(np.int64)) for s in signs],
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[in_prefix].view(np.int64))),
                     pa.array(sketches(text, h, b - a), pa.binary())],
                    ["id", "print", "n", "s1", "s2", "prefix", "sketch"])

    return run


ENTRY = "token bigint, id bigint, n int, pos int, leader bigint"


def may_pair(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, ordered by list and size, others of their list leave a chance to be similar.

    Neighbours are judged by size and place, entries further apart by size alone."""
    keep = np.zeros(len(n), bool)
    near = (token[1:] == token[:-1]) & (n[:-1] * 100 >= percent * n[1:])
    room = np.minimum((n - pos)[1:], (n - pos)[:-1]) + np.minimum(pos[1:], pos[:-1])
    near &= room * (100 + percent) >= percent * (n[1:] + n[:-1])
    keep[1:] |= near
    keep[:-1] |= near
    three = (token[2:] == token[:-2]) & (n[:-2] * 100 >= percent * n[2:])
    for k in range(3):
        keep[k: len(n) - 2 + k] |= three
    return keep


def _lists(percent: int):
    """Streams entries sorted by ``token, n, id``: those that may be similar to others of their
    list, each once, with the first of them before it that its size allows it to be similar to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leader, size = None, 0, 0
        held, done = np.zeros((4, 0), np.int64), 0  # two rows that were judged, and two that wait for what follows
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, [batch.column(x).to_numpy().astype(np.int64) for x in ("token", "id", "n", "pos")]], 1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)  # a text given twice
            rows = rows[:, new]
            end = rows.shape[1] if batch is None else max(done, rows.shape[1] - 2)
            at = done + np.flatnonzero(may_pair(rows[0], rows[2], rows[3], percent)[done:end])
            leaders = []
            for t, i, n in zip(*(rows[k, at].tolist() for k in range(3))):
                if t != token or n * percent > size * 100:
                    token, leader, size = t, i, n
                leaders.append(leader)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*rows[:, at], leaders], kinds)],
                                             ["token", "id", "n", "pos", "leader"])
            first = max(0, end - 2)
            held, done = rows[:, first:], end - first

    return run


def _tokens(width: int):
    """The whole sets of texts, in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            for a, b in portions(bounds):
                text, h, _ = shingles(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], width)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                offsets = np.searchsorted(text[new], np.arange(b - a + 1)).astype(np.int32)
                rest = batch.drop_columns(["text"]).slice(a, b - a)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rest.columns, tokens], [*rest.schema.names, "tokens"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in the ascending ``b``."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Leader:
    """A set, and others near it (pivots) kept as what they lack and have besides."""

    def __init__(self, item: int, tokens: np.ndarray, percent: int):
        self.item, self.tokens, self.percent = item, tokens, percent
        self.pivots: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def similar(self, shared: int, n: int, m: int) -> bool:
        return shared * (100 + self.percent) >= self.percent * (n + m)

    def answer(self, item: int, tokens: np.ndarray, pivots: bool) -> tuple[int, int | None]:
        """Distance to the leader, and the leader or pivot that the set links to."""
        here = _shared(self.tokens, tokens)
        shared = int(here.sum())
        distance = len(self.tokens) + len(tokens) - 2 * shared
        if self.similar(shared, len(self.tokens), len(tokens)):
            return distance, self.item
        if not pivots:
            return distance, None
        for other, n, lacks, has in self.pivots:
            derived = shared - int(_shared(lacks, tokens).sum()) + int(_shared(has, tokens).sum())
            if self.similar(derived, n, len(tokens)):
                return distance, other
        if len(self.pivots) < PIVOTS:
            self.pivots.append((item, len(tokens), self.tokens[~here], tokens[~_shared(tokens, self.tokens)]))
        return distance, None


ANSWER = "id bigint, leader bigint, distance bigint, linked bigint"


def _answers(width: int, percent: int, pivots: bool):
    """Streams texts sorted by ``leader, salt``, the leader's own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leader = None, None
        for batch in _tokens(width)(batches):
            of, salt, ids = (batch.column(x).to_pylist() for x in ("leader", "salt", "id"))
            column = batch.column("tokens")
            at, values = column.offsets.to_numpy(), column.values.to_numpy()
            out = []
            for k, key in enumerate(zip(of, salt)):
                tokens = values[at[k]: at[k + 1]].view(np.uint64)
                if key != current:
                    current, leader = key, Leader(of[k], tokens.copy(), percent)
                    continue
                out.append((ids[k], of[k], *leader.answer(ids[k], tokens, pivots)))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "leader", "distance", "linked"])

    return run


def compare_with_leaders(
    texts: DataFrame, same: DataFrame, pairs: DataFrame, width: int, percent: int, pivots: bool,
) -> DataFrame:
    """``id, leader, distance, linked`` for each pair ``leader, id`` of different sets.

    A leader with many sets is dealt to several tasks, each with its own copy. A bit filter of
    fixed size keeps most other texts out of the join; if the nodes in pairs outgrow it, more
    texts take part, and the result is the same. Texts are dealt out, as their sets are larger.
    """
    spark = texts.sparkSession
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("k"))
    members = pairs.join(sizes, "leader").select(
        "leader", F.col("id").alias("node"), F.pmod(F.xxhash64("id"), F.col("k")).alias("salt"), F.lit(1).alias("rank"))
    own = sizes.select("leader", F.col("leader").alias("node"),
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("salt"), F.lit(0).alias("rank"))
    wanted = settle(members.unionByName(own).join(same.select("id", "print", "node"), "node"), "wanted")
    bit = F.shiftrightunsigned(F.xxhash64("id", "print"), 64 - FILTER_BITS)
    bytes_of = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 3).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(b & 7 AS int))")).alias("v")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[bytes_of.column("at").to_numpy()] = bytes_of.column("v").to_numpy()

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy()
            yield batch.filter(pa.array((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1))

    some = texts.withColumn("b", bit).mapInArrow(asked_for, "id bigint, print bigint, text string, b bigint")
    rows = some.join(wanted, ["id", "print"]).select("leader", "salt", "rank", F.col("node").alias("id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", "rank", "id") \
        .mapInArrow(_answers(width, percent, pivots), ANSWER)


def spanning(root: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pairs, taken in that order, whose ends no pair before them joins; ``root`` is updated."""
    taken = []
    while len(order):
        k, order = order[0], order[1:]
        taken.append(k)
        root[root == root[b[k]]] = root[a[k]]
        order = order[root[a[order]] != root[b[order]]]
    return np.array(taken, np.int64)


def met_before(prior: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the members before an entry (``known`` of them) both have: lists in which they met already."""
    have = np.arange(BEFORE) < known[:, None]
    return ((prior[a][:, :, None] == prior[b][:, None, :]) & have[a][:, :, None] & have[b][:, None, :]).sum((1, 2))


def list_pairs(
    ids, n, pos, comp, leader, far, percent: int, sketch=None, prior=None, forest: bool = False, known=None,
) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a list (ordered by size) that may be similar and are not known to be joined.

    A pair goes no further where its sketches (rows of 64-bit words) differ in more bits than
    similar sets can differ in members. With ``prior`` (the last members before each entry that
    have lists, up to ``BEFORE``; ``known`` of them, else as many as there are places before it)
    a pair is left out where it is seen to have met in as many lists before as it has to.
    A ``forest`` gives only pairs that join what no other pair of the list joins, fewer than
    entries; if all of them are similar, so are the others joined. Its pairs need not meet
    more than once where sketches are long enough to tell unlike sets.

    Gives arrays of both ids, whether the distances to a common leader already show that
    the pair is similar, and how many lists a similar pair meets in. Blocks of the list are
    passed over where the places of their entries leave no room for the overlap.
    """
    rest = n - pos
    meets = np.where(n >= LONG, MORE + 1, 1)
    root = comp.copy() if forest else comp
    starts = np.arange(0, len(n), BLOCK)
    most, last = np.maximum.reduceat(rest, starts), np.maximum.reduceat(pos, starts)
    for at, late in enumerate(starts):
        i = np.arange(late, min(late + BLOCK, len(n)))[:, None]
        for before, early in enumerate(starts[: at + 1]):
            j = np.arange(early, min(early + BLOCK, len(n)))[None, :]
            need = -(-percent * (n[early] + n[late]) // (100 + percent))
            if n[j[0, -1]] * 100 < percent * n[late] or min(most[before], most[at]) + min(last[before], last[at]) < need:
                continue
            both, room = n[j] + n[i], np.minimum(rest[j], rest[i]) + np.minimum(pos[j], pos[i])
            ok = (j < i) & (root[j] != root[i]) & (n[j] * 100 >= percent * n[i]) & (room * (100 + percent) >= percent * both)
            slack = (100 - percent) * both
            same = leader[j] == leader[i]
            ok &= ~same | (np.abs(far[j] - far[i]) * (100 + percent) <= slack)
            later, earlier = np.nonzero(ok)
            slack, a, b = slack[later, earlier], earlier + early, later + late
            apart = np.zeros(len(a), np.int64)
            if sketch is not None and len(a):
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                near = apart * (100 + percent) <= slack
                a, b, slack, apart = a[near], b[near], slack[near], apart[near]
            if not len(a):
                continue
            sure = (leader[a] == leader[b]) & ((far[a] + far[b]) * (100 + percent) <= slack)
            often = np.minimum(meets[a], meets[b])
            if forest:
                if sketch is not None:
                    often = np.where(slack * 4 <= SKETCH * (100 + percent), 1, often)
                kept = spanning(root, a, b, np.lexsort((apart, ~sure)))
            elif prior is not None:
                kept = np.flatnonzero(met_before(prior, pos if known is None else known, a, b) < often)
            else:
                kept = slice(None)
            if len(a[kept]):
                yield ids[a[kept]], ids[b[kept]], sure[kept], often[kept]


def _list_pairs(percent: int, forest: bool = False):
    """Streams entries sorted by ``token, n, id``; a list is held as numbers, 112 bytes an entry, 72 more with ``before``."""
    names = ("id", "n", "pos", "comp", "leader", "far")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found) -> pa.RecordBatch:
            a, b, sure, meets = (np.concatenate(x) for x in zip(*found))
            of_list = [pa.array(np.full(len(a), token))] if forest else []
            return pa.RecordBatch.from_arrays(
                [*of_list, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure.astype(bool)), pa.array(meets)],
                [*["token"] * forest, "leader", "id", "sure", "meets"])

        def pairs(parts) -> Iterator[pa.RecordBatch]:
            found, size = [], 0
            *columns, sketch, before, known = (np.concatenate(x) if x[0] is not None else None for x in zip(*parts))
            for block in list_pairs(*columns, percent, sketch, before, forest, known):
                found.append(block)
                size += len(block[0])
                if size >= PAIRS:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

        token, held = None, []
        for batch in batches:
            t = batch.column("token").to_numpy()
            columns = [batch.column(x).to_numpy().astype(np.int64) for x in names]
            words = last = size = None
            if "before" in batch.schema.names:
                some = batch.column("before")
                size = some.value_lengths().to_numpy().astype(np.int64)
                last = np.zeros((len(t), BEFORE), np.int64)
                last[np.arange(BEFORE) < size[:, None]] = some.flatten().to_numpy()
            if "sketch" in batch.schema.names:
                words = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(t), SKETCH // 64)
            cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)]):
                if a == b:
                    continue
                if t[a] != token:
                    if held:
                        yield from pairs(held)
                    token, held = t[a], []
                held.append([*[c[a:b] for c in columns], *[None if x is None else x[a:b] for x in (words, last, size)]])
        if held:
            yield from pairs(held)

    return run


def _mixed_lists(placed: DataFrame, parts: int, *more: str) -> DataFrame:
    """Entries of the lists that hold several components, in the order in which ``_list_pairs`` takes them."""
    entries, of_list = placed.select("token", "id", "n", "pos", "comp", "leader", "far", "sketch", *more), Window.partitionBy("token")
    both = entries.repartition(parts, "token").select("*", F.min("comp").over(of_list).alias("lo"), F.max("comp").over(of_list).alias("hi"))
    return both.where("lo <> hi").drop("lo", "hi").sortWithinPartitions("token", "n", "id")


def _counted(pairs: DataFrame) -> DataFrame:
    """Each pair once, with the number of lists that gave it."""
    return pairs.groupBy("leader", "id").agg(
        F.max("sure").alias("sure"), F.count(F.lit(1)).alias("n"), F.max("meets").alias("meets"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``id, comp`` for every node of ``a, b`` edges: the least node that it reaches.

    Alternates between linking the larger neighbours of a node and the smaller
    ones to the least of its neighbourhood, until nothing changes. Only minima
    are taken per node, which combine before the shuffle; no node's neighbours
    are ever gathered.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settle(small.unionByName(least.toDF("u", "v")).distinct(), name)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        state = tuple(row)


def similar_components(transcripts: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Link transcripts whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``transcripts``: ``id, text``; other columns are ignored. Words are
    separated by ASCII white space, without case (A-Z); a set holds the distinct
    runs of ``width`` words, of a text with fewer words all of them as one.

    Returns one row per input row: ``id, text_hash, n_shingles, component`` (the
    smallest id reachable over links, its own included) and ``representative``:
    whether this id and text are the least of the component, so that exactly one
    text of each component has it. A null or empty text has an empty set, links
    with nothing and represents itself. A null id is the smallest id. Repeated
    rows have equal sets and so share a component. An empty table gives none.
    """
    texts = keyed(transcripts).select("id", F.xxhash64("text").alias("print"), "text")
    spark = texts.sparkSession
    cells = texts.select("text").mapInArrow(_cells(width), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones((1 << WORD_BITS) + (1 << SHINGLE_BITS))  # at most one row per cell was collected
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    logs = tuple(np.split(np.log2(counts).astype(np.float32), [1 << WORD_BITS]))
    total = float(np.log2(counts[: 1 << WORD_BITS].sum()))
    sets = settle(texts.mapInArrow(_sets(width, percent, logs, total), SETS), "sets")
    filled = sets.where("n > 0")
    # Equal sets are one node, numbered when the table is written.
    least = filled.groupBy("s1", "s2").agg(F.min(F.struct("id", "print")).alias("x"), F.first("sketch").alias("sketch"))
    numbered = settle(least.select("s1", "s2", "x.id", "x.print", "sketch", F.monotonically_increasing_id().alias("node")), "equal_sets")
    same, sketch = numbered.drop("sketch"), numbered.select(F.col("node").alias("id"), "sketch")
    index = filled.join(same, ["s1", "s2", "id", "print"]).select(F.col("node").alias("id"), "n", F.posexplode("prefix").alias("pos", "token"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = settle(
        index.select("token", "id", "n", "pos").repartition(parts, "token").sortWithinPartitions("token", "n", "id")
        .mapInArrow(_lists(percent), ENTRY), "lists")
    # A set in fewer lists than it has to share with a similar one has none; all that are similar to it are LONG.
    enough = F.when(F.col("n") * percent >= 100 * LONG, MORE + 1).otherwise(1)
    nodes = settle(
        entries.groupBy("id").agg(F.count(F.lit(1)).alias("lists"), F.first("n").alias("n")).where(F.col("lists") >= enough).select("id"), "nodes")

    # Each set is compared with the leader that it shares most lists with, if they are many
    # enough for the two to be near each other; whatever is left out here is looked at below.
    votes = entries.where("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"), F.first("n").alias("size"))
    votes = votes.where(F.col("n") * 400 >= F.col("size") * (100 - percent))
    chosen = votes.groupBy("id").agg(F.max(F.struct("n", "leader")).alias("best")).select("id", F.col("best.leader").alias("leader"))
    chosen = settle(chosen, "leaders")
    answers = settle(compare_with_leaders(texts, same, chosen, width, percent, True).distinct(), "answers")
    links = answers.where("linked IS NOT NULL").select(F.col("id").alias("a"), F.col("linked").alias("b"))
    joined = components(links, "first_components")

    # What is left: pairs of a list in different components, decided by distance where possible.
    far = answers.where("id <> leader").select("id", F.col("leader").alias("of"), "distance")

    def placed(some: DataFrame, joined: DataFrame) -> DataFrame:
        known = nodes.join(joined, "id", "left").join(far, "id", "left").join(sketch, "id").select(
            "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("of", "id").alias("leader"),
            F.coalesce("distance", F.lit(0)).alias("far"), "sketch")
        return some.select("token", "id", "n", "pos").join(known, "id")

    spanned = settle(
        _mixed_lists(placed(entries, joined), parts).mapInArrow(
            _list_pairs(percent, True), "token bigint, leader bigint, id bigint, sure boolean, meets bigint"), "spanning")
    pairs = settle(_counted(spanned), "pairs")
    open_pairs = pairs.where("NOT sure AND n >= meets").select("leader", "id")
    checked = settle(compare_with_leaders(texts, same, open_pairs, width, percent, False), "checked")
    more = checked.where("linked IS NOT NULL").select("id", "leader").unionByName(pairs.where("sure").select("id", "leader"))
    whole = components(links.unionByName(more.toDF("a", "b")), "components")

    # Where a pair proved unlike, its list may hold others for it: all that are not joined by now.
    failed = pairs.join(more, ["leader", "id"], "left_anti").select("leader", "id")
    again = settle(spanned.join(failed, ["leader", "id"]).select("token").distinct(), "lists_again")
    if not again.isEmpty():
        # Pairs that are not joined by now meet in these lists alone.
        earlier = Window.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1)
        left = placed(entries.join(again, "token"), whole).withColumn("before", F.collect_list("token").over(earlier))
        rest = _counted(_mixed_lists(left, parts, "before").mapInArrow(
            _list_pairs(percent), "leader bigint, id bigint, sure boolean, meets bigint"))
        rest = settle(rest.where("sure OR n >= meets").join(checked, ["leader", "id"], "left_anti"), "pairs_again")
        open_pairs = rest.where("NOT sure").select("leader", "id")
        linked = compare_with_leaders(texts, same, open_pairs, width, percent, False).where("linked IS NOT NULL")
        more = linked.select("id", "leader").unionByName(rest.where("sure").select("id", "leader"))
        whole = components(whole.toDF("a", "b").unionByName(more.toDF("a", "b")), "components")
    placed_sets = same.select("s1", "s2", F.struct("id", "print").alias("first"), F.col("node").alias("id")) \
        .join(whole, "id", "left").select("s1", "s2", "first", F.coalesce("comp", "id").alias("comp"))
    smallest = placed_sets.groupBy("comp").agg(F.min("first").alias("first"))
    of_set = placed_sets.drop("first").join(smallest, "comp").select("s1", "s2", "first")
    found = sets.join(of_set, ["s1", "s2"], "left").withColumn("component", F.coalesce("first.id", "id"))
    own = F.coalesce((F.col("first.id") == F.col("id")) & (F.col("first.print") == F.col("print")), F.lit(True))
    return found.select(id_or_null("id").alias("id"), F.col("print").alias("text_hash"), F.col("n").cast("bigint").alias("n_shingles"),
                        id_or_null("component").alias("component"), own.alias("representative"))
