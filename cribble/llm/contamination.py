"""Finding passages of evaluation items in transcripts, by winnowing.

Each window of L words selects its k-word gram with the least hash, and the
selected grams are the fingerprints of a text. Equal windows select the same
gram, so joining fingerprints and extending each match word by word finds every
shared span of L words or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import settle
from cribble.llm.words import ALNUM, LOWER, Rolling, Words, buffers, portions, same_text, window_min

SPAN = 13
GRAM = 7
#: The filter of least hashes has at most this many bits (16 MB), however many there are.
MAX_FILTER_BITS = 27

#: A fingerprint: its place, the window length it was selected for, the hash of the gram,
#: and the hashes of the words before it (nearest first) and after it that a window can reach.
PRINT = ["start", "span", "low", "before", "after"]


def selected(words: Words, span: int, roll: Rolling, maybe=None) -> tuple[np.ndarray, np.ndarray]:
    """Places (of words) and hashes of the grams that the windows of ``span`` words select.

    ``maybe`` tells of least hashes which are worth looking at.
    """
    gram = min(GRAM, span)
    width = span - gram + 1
    hashes = roll.grams(words.hashes, gram)
    low = window_min(hashes, width)
    at = np.flatnonzero(same_text(words.first, span)[: len(low)])
    if maybe is not None:
        at = at[maybe(low[at])]
    place = np.full(len(at), -1)
    for k in range(width - 1, -1, -1):  # the leftmost of equal ones
        place[hashes[at + k] == low[at]] = k
    place = np.unique(at + place)
    return place, hashes[place]


def around(words: Words, text: np.ndarray, place: np.ndarray, span: int) -> list[pa.ListArray]:
    """Hashes of the up to ``span - gram`` words of the same text on either side of each gram."""
    gram = min(GRAM, span)
    step = np.arange(span - gram)
    out = []
    for at, ok in ((place[:, None] - 1 - step, lambda x: x >= words.first[text[place]][:, None]),
                   (place[:, None] + gram + step, lambda x: x < words.first[text[place] + 1][:, None])):
        inside = ok(at)
        offsets = np.concatenate(([0], np.cumsum(inside.sum(axis=1)))).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.hashes[at[inside]].view(np.int64))))
    return out


def _prints(words: Words, spans: list[int], fits=None, maybe=None) -> tuple[np.ndarray, pa.StructArray]:
    """The number of the text of each fingerprint, and the fingerprints, by text and place."""
    roll, text = Rolling(2), words.text_of()
    which, parts = [], []
    for n in spans:
        place, low = selected(words, n, roll, maybe)
        if fits is not None:
            ok = fits(text[place], n)
            place, low = place[ok], low[ok]
        which.append(text[place])
        parts.append(pa.StructArray.from_arrays(
            [pa.array((place - words.first[text[place]]).astype(np.int32)), pa.array(np.full(len(place), n, np.int32)),
             pa.array(low.view(np.int64)), *around(words, text, place, n)], PRINT))
    order = np.argsort(np.concatenate(which), kind="stable")
    return np.concatenate(which)[order], pa.concat_arrays(parts).take(pa.array(order))


def _item_prints(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            words = Words(data, bounds, ALNUM, LOWER)
            sizes = np.diff(words.first)
            spans = sorted({min(int(s), span) for s in sizes if s})
            if spans:  # an item of fewer words than ``span`` is one window
                text, found = _prints(words, spans, lambda t, n: np.minimum(sizes[t], span) == n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *found.flatten()[1:]], ["item_id", *PRINT[1:]])

    return run


def _scan(spans: list[int], bits: np.ndarray, shift: int):
    def maybe(low: np.ndarray) -> np.ndarray:
        cell = low >> np.uint64(shift)
        return ((bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            for a, b in portions(bounds):
                words = Words(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], ALNUM, LOWER)
                # Without items there is no length of window, and nothing to find.
                text, found = _prints(words, spans or [SPAN], maybe=maybe)
                offsets = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(words.first)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found)],
                    ["id", "text_hash", "n_words", "prints"])

    return run


def _alike(a: str, b: str) -> str:
    """SQL for how many first elements of two arrays are equal."""
    first = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return f"if({first} = 0, size({a}), cast({first} - 1 AS int))"


def find_contamination(
    transcripts: DataFrame, held_out: DataFrame, span: int = SPAN, min_percent: int = 5,
) -> DataFrame:
    """Mark the words of transcripts that lie in a window of a held-out item.

    ``transcripts``: ``id, text``; ``held_out``: ``item_id, text``; other
    columns are ignored. Words are runs of letters and digits, anything beyond
    ASCII included, without case (A-Z). The windows of an item are its ``span``
    consecutive words; an item with fewer words is one window, one without words none.

    Returns one row per transcript row: ``id, text_hash`` (which tells rows with
    the same id apart), ``n_words, n_hit`` (words inside an
    occurrence of any window), ``items`` (sorted distinct ids of items with
    such windows), ``contaminated`` (a hit, and ``min_percent`` of the words or
    more hit). A null or empty text has no words. Repeated rows are judged one
    by one; items with the same id count as one; a null item id takes part in
    hits but is not listed. An empty table of items leaves all clean.

    Texts are read once and never shuffled. What is broadcast is a bit filter
    of at most ``2 ** MAX_FILTER_BITS`` bits; if items outgrow it, more fingerprints
    go into the join, and the result is the same. A fingerprint carries the hashes of
    the words that a window around it can reach, so matches are extended where they
    meet: by up to ``span - GRAM`` words on each side, which covers every window that
    selected it; longer spans are the union of their windows.
    """
    spark = transcripts.sparkSession
    item_rows = held_out.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = item_rows.schema["item_id"].dataType.simpleString()
    known = settle(item_rows.mapInArrow(
        _item_prints(span), f"item_id {schema}, span int, low bigint, before array<bigint>, after array<bigint>").distinct(), "item_prints")
    lows = known.select("low").distinct()
    n = max(1, lows.count())
    width = min(MAX_FILTER_BITS, max(10, math.ceil(math.log2(16 * n))))
    cells = F.shiftrightunsigned("low", 64 - width)
    bits = np.zeros(1 << (width - 3), np.uint8)
    set_cells = lows.select(cells.alias("c")).distinct().toArrow().column("c").to_numpy()
    np.bitwise_or.at(bits, set_cells >> 3, (1 << (set_cells & 7)).astype(np.uint8))
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # at most ``span`` values

    texts = transcripts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()
    scanned = texts.mapInArrow(_scan(spans, bits, 64 - width), f"id {kind}, text_hash bigint, n_words bigint, prints array<"
                               "struct<start:int,span:int,low:bigint,before:array<bigint>,after:array<bigint>>>")
    rows = settle(scanned.withColumn("row", F.monotonically_increasing_id()), "contamination")
    # Items that agree around a gram are met once, whatever their number.
    places = known.groupBy("span", "low", "before", "after").agg(F.collect_set("item_id").alias("ids")).selectExpr(
        "span", "low", "before AS b", "after AS a", "ids")
    gram = f"least({GRAM}, span)"
    occurring = rows.select("row", F.inline("prints")).join(places, ["span", "low"]).selectExpr(
        "row", "start", "span", "ids", f"{_alike('before', 'b')} AS back", f"{_alike('after', 'a')} AS on"
    ).where(f"back + {gram} + on >= span").selectExpr(
        "row", "start - back AS start", f"back + {gram} + on AS span", "ids")
    per_text = occurring.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "span"))).alias("w"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate("w", zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["span"] - F.greatest(x["start"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], x["start"] + x["span"]).alias("end")), lambda acc: acc["n"])
    found = per_text.select("row", hit.cast("bigint").alias("n_hit"), "items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.drop("prints").join(found, "row", "left").select(
        "id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{schema}>")).alias("items"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * min_percent)).alias("contaminated"))
