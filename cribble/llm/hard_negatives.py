"""Hard negatives for training embeddings: close rows of another label.

Every vector is turned into whole numbers, rotated by random signs and a
Hadamard transform, and stored as a few layers of one-bit codes: the signs of
what the layers before have left (rotated anew), each with its alignment (how far
the vector reaches along its code). An anchor's rotated numbers are cut into bit
planes, so that its product with a code is a handful of popcounts. What the
layers leave is bounded by the Cauchy-Schwarz inequality, which gives each pair
an interval that holds its score for certain. Only pairs whose interval reaches
into a range that still counts are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribble.llm.shared import NULL_ID, id_or_null, settle

LAYERS = 5
FULL_LAYERS = 3
PLANES = 5
#: Rows that a task holds at once; anchors stream past them.
BLOCK_ROWS = 131_072
#: Anchors and rows of one step inside a task.
STEP_ANCHORS = 64
STEP_ROWS = 4_096
FIRST_ROWS = 256
#: Squared norms from here on could make a score that 64 bits don't hold.
NORM_LIMIT = 2**62

CODED = ("id bigint, label string, is_anchor boolean, numbers binary, norm double, "
         "codes binary, alignments binary, residuals binary")
FOUND = "anchor binary, place int, id bigint, score bigint"


def rotate(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Random signs, then a Hadamard transform scaled to keep lengths and products."""
    out = np.zeros((len(vectors), len(signs)))
    out[:, :vectors.shape[1]] = vectors
    out *= signs / sqrt(len(signs))
    half = 1
    while half < len(signs):
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(out), -1)
        half *= 2
    return out


def _bits(mask: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words."""
    packed = np.packbits(mask, axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def encode(vectors: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, layers, words), alignments and lengths of what each layer leaves (rows, layers).

    Each layer rotates what is left, by its row of ``signs``, and takes ``alignment *
    code`` from it, so that the rest is orthogonal to the layer's code.
    """
    rest, codes, aligned, left = vectors, [], [], []
    for turn in signs:
        rest = rotate(rest, turn)
        positive = rest >= 0
        alignment = np.abs(rest).mean(1)
        rest -= np.where(positive, alignment[:, None], -alignment[:, None])
        codes.append(_bits(positive))
        aligned.append(alignment)
        left.append(np.sqrt((rest * rest).sum(1)))
    return np.stack(codes, 1), np.stack(aligned, 1), np.stack(left, 1)


class Anchors:
    """A batch of anchors, each with its bit planes per layer and the score ranges it looks for."""

    def __init__(self, keys, ids, labels, numbers, low, high, signs):
        self.keys, self.ids, self.labels, self.numbers, self.low, self.high = keys, ids, labels, numbers, low, high
        self.width, rotated, layers = signs.shape[1], numbers, []
        self.norm = np.sqrt((numbers.astype(float) ** 2).sum(1))
        for turn in signs:
            rotated = rotate(rotated, turn)
            start = rotated.min(1)
            step = np.maximum((rotated.max(1) - start) / (2**PLANES - 1), 1e-300)
            units = np.rint((rotated - start[:, None]) / step[:, None]).astype(np.int64)
            error = np.abs(rotated - start[:, None] - units * step[:, None]).sum(1)
            planes = np.stack([_bits((units >> j) & 1 == 1) for j in range(PLANES)])
            layers.append((planes, units.sum(1), start, step, error))
        self.planes, self.total, self.start, self.step, self.error = (list(x) for x in zip(*layers))

    def product(self, layer: int, at, codes: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Anchors times codes: twice the popcount at the ones, less the sum of all."""
        ones = 0
        for j, plane in enumerate(self.planes[layer]):
            count = np.bitwise_count((plane[at][:, None] if signs.ndim == 2 else plane[at]) & codes)
            count = count[..., 0].astype(np.int32) if self.width == 64 else count.sum(-1, dtype=np.int32)
            ones = ones + (count << j)
        start, step = self.start[layer][at], self.step[layer][at]
        if signs.ndim == 2:
            start, step = start[:, None], step[:, None]
        return (2 * step) * ones + start * signs - step * self.total[layer][at].reshape(step.shape)


class Pairs:
    """What is known of the scores of pairs of anchors and rows, layer by layer."""

    def __init__(self, a: Anchors, block: "Block", at, rows):
        # ``at`` and ``rows`` are either a column and a row of indices, or two lists of pairs.
        self.a, self.block, self.at, self.rows = a, block, at, rows
        self.estimate, self.error, self.layer = 0.0, 0.0, 0

    def refine(self) -> tuple[np.ndarray, np.ndarray]:
        """Take one more layer in; the interval that then holds the score.

        The rest is orthogonal to the last code, so only the anchor's part across that
        code meets it. Errors of the bit planes count by the alignments.
        """
        a, b, i = self.a, self.block, self.layer
        alignment, error = b.alignments[i][self.rows], a.error[i][self.at]
        if self.at.ndim == 2:
            product = a.product(i, self.at[:, 0], b.codes[i][self.rows[0]][None], b.signs[i][self.rows])
        else:
            product = a.product(i, self.at, b.codes[i][self.rows], b.signs[i][self.rows])
        self.estimate, self.error, self.layer = self.estimate + product * alignment, self.error + error * alignment, i + 1
        along = np.maximum(np.abs(product) - error, 0.0)
        norm = a.norm[self.at]
        across = np.sqrt(np.maximum(norm * norm - along * along / a.width, 0.0))
        slack = across * b.residuals[i][self.rows] + self.error + 1e-9 * norm * b.norm[self.rows] + 1e-6
        return self.estimate - slack, self.estimate + slack

    def pick(self, hit: np.ndarray) -> Pairs:
        """The pairs that remain, as lists."""
        if self.at.ndim == 2:
            x, y = np.nonzero(hit)
            out = Pairs(self.a, self.block, self.at[x, 0], self.rows[0, y])
            out.estimate, out.error = self.estimate[x, y], self.error[x, y]
        else:
            out = Pairs(self.a, self.block, self.at[hit], self.rows[hit])
            out.estimate, out.error = self.estimate[hit], self.error[hit]
        out.layer = self.layer
        return out


def _wanted(low, high, least, most) -> np.ndarray:
    """Whether an interval meets any of an anchor's ranges (last axis)."""
    hit = np.zeros(low.shape, dtype=bool)
    for i in range(least.shape[-1]):
        hit |= (high >= least[..., i]) & (low <= most[..., i])
    return hit


class Block:
    """Rows in memory, in order of their labels, and the search among them."""

    def __init__(self, ids, labels, numbers, norm, codes, alignments, residuals):
        order = np.lexsort((ids, labels))
        self.names, self.labels = np.unique(labels[order], return_inverse=True)
        self.ids, self.numbers = ids[order], numbers[order]
        self.norm, width = norm[order], 64 * codes.shape[2]
        self.codes = [np.ascontiguousarray(x) for x in codes[order].transpose(1, 0, 2)]
        self.signs = [2.0 * np.bitwise_count(x).sum(1, dtype=np.int32) - width for x in self.codes]
        self.alignments = [np.ascontiguousarray(x) for x in alignments[order].T]
        self.residuals = [np.ascontiguousarray(x) for x in residuals[order].T]

    def search(self, a: Anchors, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """The best ``k`` rows of each anchor in each of its ranges: anchor, range, id, score."""
        n, ranges = a.low.shape
        at, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        least = a.low.astype(float)
        place = np.searchsorted(self.names, a.labels)
        known = self.names[np.minimum(place, len(self.names) - 1)] == a.labels
        labels = np.where(known, place, -1)
        x, end = 0, len(self.ids)
        if same:  # a batch has one label
            x, end = np.searchsorted(self.labels, [labels[0], labels[0] + 1])
        step = FIRST_ROWS  # small at first, until there are scores to beat
        while x < end:
            new = self._scored(a, labels, least, slice(x, min(end, x + step)), same)
            x, step = x + step, min(2 * step, STEP_ROWS)
            if not len(new[0]):
                continue
            at, ids, scores = (np.concatenate(z) for z in zip((at, ids, scores), new))
            keep = np.zeros(len(at), dtype=bool)
            for i in range(ranges):
                chosen, last = self._best(a, i, at, ids, scores, k)
                keep[chosen] = True
                least[at[last], i] = np.maximum(least[at[last], i], scores[last])
            at, ids, scores = at[keep], ids[keep], scores[keep]
        out = [(at[c], np.full(len(c), i), ids[c], scores[c])
               for i in range(ranges) for c in [self._best(a, i, at, ids, scores, k)[0]]]
        return tuple(np.concatenate(z) for z in zip(*out))

    def _best(self, a: Anchors, i: int, at, ids, scores, k: int):
        inside = np.flatnonzero((scores >= a.low[at, i]) & (scores <= a.high[at, i]))
        order = inside[np.lexsort((ids[inside], ~scores[inside], at[inside]))]
        owner = at[order]
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)
        return order[rank < k], order[rank == k - 1]

    def _scored(self, a: Anchors, labels, least, rows: slice, same: bool) -> tuple[np.ndarray, ...]:
        most = a.high.astype(float)
        pairs = Pairs(a, self, np.arange(len(a.ids))[:, None], np.arange(rows.start, rows.stop)[None])
        # The first layers for every pair, the others for those that remain.
        for _ in range(FULL_LAYERS):
            low, high = pairs.refine()
        hit = _wanted(low, high, least[:, None], most[:, None])
        hit &= (self.labels[None, rows] == labels[:, None]) == same
        hit &= self.ids[None, rows] != a.ids[:, None]
        pairs = pairs.pick(hit)
        for _ in range(FULL_LAYERS, len(self.codes)):
            low, high = pairs.refine()
            pairs = pairs.pick(_wanted(low, high, least[pairs.at], most[pairs.at]))
        score = np.empty(len(pairs.at), np.int64)
        for x in range(0, len(score), 1 << 16):
            part = slice(x, x + (1 << 16))
            score[part] = (a.numbers[pairs.at[part]] * self.numbers[pairs.rows[part]]).sum(1)
        return pairs.at, self.ids[pairs.rows], score


def _matrix(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def _coder(dim: int, signs: np.ndarray, scale: float):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("is_anchor", pa.bool_()), ("numbers", pa.binary()),
                            ("norm", pa.float64()), ("codes", pa.binary()), ("alignments", pa.binary()), ("residuals", pa.binary())])
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((len(batch), dim))
            whole[np.arange(dim)[None, :] < lengths[:, None]] = np.floor(scale * vectors.flatten().to_numpy())
            norm = np.sqrt((whole * whole).sum(1))
            fits = norm < sqrt(NORM_LIMIT)
            whole, norm = whole[fits], norm[fits]
            codes, aligned, left = encode(whole, signs)
            rows = batch.filter(pa.array(fits))
            whole = whole.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                rows.column("id"), rows.column("label"), rows.column("is_anchor"),
                pa.array([x.tobytes() for x in whole], pa.binary()), pa.array(norm), pa.array([x.tobytes() for x in codes], pa.binary()),
                pa.array([x.tobytes() for x in aligned], pa.binary()), pa.array([x.tobytes() for x in left], pa.binary())], schema=schema)

    return code


def _seeker(dim: int, signs: np.ndarray, k: int, same: bool):
    """Rows of a cell come first and stay, its anchors then stream past them."""
    layers, words = len(signs), signs.shape[1] // 64

    def block_of(parts: list[pa.RecordBatch]) -> Block | None:
        table = pa.Table.from_batches(parts).combine_chunks()
        if not len(table):
            return None
        got = lambda name, kind, *shape: _matrix(table.column(name).combine_chunks(), kind, shape)
        return Block(
            table.column("id").to_numpy(), np.array(table.column("label").to_pylist()),
            got("numbers", np.int32, dim).astype(np.int64), table.column("norm").to_numpy(),
            got("codes", np.uint64, layers, words), got("alignments", float, layers), got("residuals", float, layers))

    def found(block: Block, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = np.array(rows.column("label").to_pylist())
        order = np.argsort(labels, kind="stable")
        edges = [*np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1]]), len(order)] if same else [0, len(order)]
        keys, ids = np.array(rows.column("anchor").to_pylist(), dtype=object), rows.column("id").to_numpy()
        numbers = _matrix(rows.column("numbers"), np.int32, (dim,)).astype(np.int64)
        low, high = rows.column("low").to_pylist(), rows.column("high").to_pylist()
        for first, end in zip(edges, edges[1:]):
            for x in range(first, end, STEP_ANCHORS):
                part = order[x:min(end, x + STEP_ANCHORS)]
                width = max(len(low[i]) for i in part)
                # Ranges of anchors with fewer of them are empty.
                bounds = [np.array([list(z[i]) + [fill] * (width - len(z[i])) for i in part], dtype=np.int64).reshape(len(part), width)
                          for z, fill in ((low, 1), (high, 0))]
                if not width:
                    continue
                a = Anchors(keys[part], ids[part], labels[part], numbers[part], *bounds, signs)
                at, place, near, score = block.search(a, k, same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.keys[at], pa.binary()), pa.array(place, pa.int32()), pa.array(near), pa.array(score)],
                    schema=pa.schema([("anchor", pa.binary()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, block = None, [], None
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            turn = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])])
            for first, end in zip(turn, [*turn[1:], len(cells)]):
                rows = batch.slice(first, end - first)
                if cells[first] != cell:
                    cell, parts, block = cells[first], [], None
                if not asks[first]:
                    parts.append(rows)
                    continue
                if parts:
                    block, parts = block_of(parts), []
                if block is not None:
                    yield from found(block, rows)

    return seek


def _grid(n: int, anchors: int, cores: int) -> tuple[int, int]:
    """Into how many blocks rows are dealt, and into how many parts the anchors of a block.

    Blocks fit in a task. Beyond that, there are cells enough for all cores to be busy, split
    so that copies of rows and of anchors take about as much room.
    """
    blocks = max(ceil(n / BLOCK_ROWS), min(cores, ceil(sqrt(cores * n / max(1, anchors)))), 1)
    return blocks, max(1, ceil(3 * cores / blocks))


def _search(coded: DataFrame, anchors: DataFrame, grid: tuple[int, int], seeker, k: int) -> DataFrame:
    """All anchors against all rows; of what the cells return, the best ``k`` per anchor and range."""
    blocks, parts = grid
    deal = F.pmod(F.xxhash64("id", "label", "numbers"), F.lit(blocks)).cast("int")
    share = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(parts)).cast("int")
    none, scores = F.lit(None), "array<bigint>"
    rows = coded.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: deal * parts + i)).alias("cell"), F.lit(False).alias("asks"),
        "id", "label", "numbers", "norm", "codes", "alignments", "residuals",
        none.cast("binary").alias("anchor"), none.cast(scores).alias("low"), none.cast(scores).alias("high"))
    ask = anchors.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * parts + share)).alias("cell"), F.lit(True).alias("asks"),
        "id", "label", "numbers", none.cast("double").alias("norm"),
        *[none.cast("binary").alias(c) for c in ("codes", "alignments", "residuals")], "anchor", "low", "high")
    dealt = rows.unionByName(ask).repartition(blocks * parts, "cell").sortWithinPartitions("cell", "asks", "label")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return dealt.mapInArrow(seeker, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine_hard_negatives(
    items: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: float = 256.0, seed: int = 11,
) -> DataFrame:
    """For anchors and their nearest rows of the same label, near rows of another label.

    ``items``: ``id, label, embedding``, as ``attach_embeddings`` and the labelling
    stages give them for items of the queue (``label`` of any type, ``embedding`` an array of
    numbers); other columns are ignored. ``is_anchor`` is an expression over ``items``. A
    component ``x`` counts as ``floor(scale * x)``; a row's score is the whole-number
    product with the anchor's. An anchor's positives are its best ``positives`` rows of its
    label, ties by the smaller id. For each, the best ``negatives`` rows of other
    labels with ``low_percent * positive_score <= 100 * negative_score <= high_percent *
    positive_score`` are returned. All pairs of an anchor and a row are judged, in blocks;
    the stored codes decide which of them need a score, and none is lost.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    Rows without label or vector, or with a null or non-finite component, take no part,
    nor do those so long (norms from 2^31 on, scaled) that scores exceed 64 bits.
    Shorter vectors end in zeros. Rows that repeat id, label and vector count once; rows that
    share an id alone are rows of their own, but never each other's positives or negatives. A null
    id comes before all others and is given back as null. Empty tables give no rows.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    usable = items.select(
        F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col("label").cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), vector.alias("embedding"),
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).dropDuplicates(["id", "label", "embedding"])
    spark = items.sparkSession
    dim = max(1, items.agg(F.max(F.size("embedding"))).first()[0] or 1)
    width = max(64, 1 << (dim - 1).bit_length())
    signs = np.where(np.random.default_rng(seed).random((LAYERS, width)) < 0.5, -1.0, 1.0)
    coded = settle(usable.mapInArrow(_coder(dim, signs, scale), CODED), "codes")
    n, n_anchors = coded.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    grid = _grid(n, n_anchors, spark.sparkContext.defaultParallelism)

    key = F.unhex(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.hex("numbers"), "label")))
    anchors = coded.where("is_anchor").select(key.alias("anchor"), "id", "label", "numbers")
    everything = F.array(F.lit(-2**63).cast("bigint")), F.array(F.lit(2**63 - 1).cast("bigint"))
    near = _search(coded, anchors.select("*", everything[0].alias("low"), everything[1].alias("high")), grid,
                   _seeker(dim, signs, positives, True), positives)
    # At most ``positives`` rows in each group.
    chosen = settle(near.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")

    def bound(percent: int, up: bool) -> Column:
        """The whole scores s with 100 s >= percent * p, or <= it."""
        def one(p: Column) -> Column:
            exact = p["score"].cast("decimal(38,0)") * percent
            part = F.try_divide(exact, F.lit(100).cast("decimal(3,0)"))
            return (F.ceil(part) if up else F.floor(part)).cast("bigint")
        return F.transform("positives", one)

    asked = anchors.join(chosen, "anchor").select("*", bound(low_percent, True).alias("low"), bound(high_percent, False).alias("high"))
    far = _search(coded, asked.drop("positives"), grid, _seeker(dim, signs, negatives, False), negatives)
    positive = F.get("positives", F.col("place"))
    return far.withColumnRenamed("id", "negative_id").join(
        anchors.join(chosen, "anchor").select("anchor", F.col("id").alias("anchor_id"), "positives"), "anchor",
    ).select(
        id_or_null("anchor_id").alias("anchor_id"),
        F.when(positive["id"] != NULL_ID, positive["id"]).alias("positive_id"), "rank",
        id_or_null("negative_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
